"""SQL for DuckDB of the periodic runs and of the conversation repair, by other ways than the operators': all pairs of equal words, and
one pass over each conversation that keeps the best way to each last role."""

from __future__ import annotations

from .conversation_repair import DELETE, INSERT, REROLE, TRUNCATED
from .periodic_runs import LEAST, POWER


def _crc32(text: str) -> str:
    """The checksum of an ASCII text: for each byte one number that is mixed in, then eight shifts, marked -1."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) ELSE {shift} END), 4294967295::BIGINT)"


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

PERIODIC_RUNS = f"""
WITH h AS (SELECT doc_id, {_WORDS} AS w, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN made THEN g % n END AS a FROM g), p AS (SELECT *, CASE WHEN made THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
words AS (SELECT doc_id, n, i, CASE WHEN made AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {POWER} * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {POWER} * q)),
runs AS (SELECT doc_id, s, length, min(q) AS q FROM stretches GROUP BY doc_id, s, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, s, q) AS k FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period, (1000 * length // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b ON d.doc_id = b.doc_id AND k = 1 LEFT JOIN kept ON kept.doc_id = d.doc_id"""


def _plus(way: str, cost: int | str, letter: str) -> str:
    return f"{{'c': {way}.c + {cost}, 'x': {way}.x || '{letter}'}}"


_FAR = "{'c': 1000000000000::BIGINT, 'x': ''}"
# the best ways to nothing, system, user and assistant, before a turn, with what can be inserted
_U = f"least(b.u, {_plus('b.n', INSERT, 'I')}, {_plus('b.s', INSERT, 'I')}, {_plus('b.a', INSERT, 'I')})"
_A = f"least(b.a, {_plus(f'({_U})', INSERT, 'I')})"


def _taken(way: str, role: str) -> str:
    stay = f"CASE WHEN r.t THEN {TRUNCATED} ELSE 0 END"
    return f"CASE WHEN r.i = '{role}' THEN {_plus(way, f'({stay})', 'K')} ELSE {_plus(way, f'{REROLE} + ({stay})', 'R')} END"


def _step() -> str:
    gone = {k: _plus(w, DELETE, "D") for k, w in (("n", "b.n"), ("s", "b.s"), ("u", f"({_U})"), ("a", f"({_A})"))}
    stays = {
        "n": gone["n"],
        "s": f"least({gone['s']}, CASE WHEN r.i = 's' THEN {_plus('b.n', f'(CASE WHEN r.t THEN {TRUNCATED} ELSE 0 END)', 'K')} ELSE {_FAR} END)",
        "u": f"least({gone['u']}, {_taken('b.n', 'u')}, {_taken('b.s', 'u')}, {_taken(f'({_A})', 'u')})",
        "a": f"least({gone['a']}, {_taken(f'({_U})', 'a')})",
    }
    ways = ", ".join(f"'{k}': CASE WHEN r.f THEN {gone[k]} ELSE {stays[k]} END" for k in "nsua")
    return f"{{'f': false, 't': false, 'i': '', {ways}}}"


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_END = f"right(rtrim(text, {_SPACE}), 1)"

CONVERSATION_REPAIR = f"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
rows AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS twice FROM raw WHERE h <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), twice) AS pos FROM rows),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, {_END} AS last, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM t),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM m),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
  list_prepend({{'f': false, 't': false, 'i': '', 'n': {{'c': 0::BIGINT, 'x': ''}}, 's': {_FAR}, 'u': {_FAR}, 'a': {_FAR}}}, list({{'f': fault IN ('b', 'd'), 't': fault = 't', 'i': left(role, 1), 'n': {_FAR}, 's': {_FAR}, 'u': {_FAR}, 'a': {_FAR}}} ORDER BY pos)) AS l FROM f GROUP BY conv_id),
b AS (SELECT * EXCLUDE (l), list_reduce(l, lambda b, r: {_step()}) AS b FROM s),
w AS (SELECT * EXCLUDE (b), least(b.n, {_A}) AS w FROM b),
letters AS (SELECT conv_id, unnest(string_split(w.x, '')) AS e, generate_subscripts(string_split(w.x, ''), 1) AS k FROM w WHERE w.x <> ''),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS o, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id) AS n FROM letters),
said AS (SELECT p.conv_id, string_agg(CASE WHEN e = 'K' THEN t.role WHEN (o - n % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY k) AS said FROM placed p LEFT JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND p.pos = t.pos WHERE e <> 'D' GROUP BY p.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.x, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN w ON c.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN said s ON c.conv_id IS NOT DISTINCT FROM s.conv_id"""
