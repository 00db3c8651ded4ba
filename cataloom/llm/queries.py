"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Tokenizer file of the contracts, the id that ends a document, and the most tokens of a context.
TOKENIZER, END_ID, MAX_TOKENS = "word_bpe_49k.json", 2, 2048
#: Target weights of sources; any other source has weight 1.
MIX_WEIGHTS, MIX_SEED = {"src0": 3.0, "src1": 2.0, "src2": 0.5}, 17

#: Rules of the contract: (host, path, verdict).
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), max_tokens=MAX_TOKENS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import poisson_mix

    return poisson_mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_table

    return token_table(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import kept_lines, line_bitmaps

    docs = table(spark, sf_dir, "documents")
    out = kept_lines(docs, line_bitmaps(docs, min_docs=10, min_chars=1, keep_first=False))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import fit_labeller, main_text

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit_labeller(pages))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import set_components

    return set_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, run_digests

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), periodic_by_key=True))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (op1_token_counts, op2_url_filter, op3_decontamination, op4_quality_rules, op5_source_mixing, op6_suffix_dedup, op7_token_store, op8_near_dedup, op9_line_dedup, op10_html_extraction)
    return {f.__name__: f for f in (*numbered, op11_ngram_join, op12_periodic_runs, op13_conversation_repair)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, {empty})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".replace("{empty}", "''")

SQL = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(x) AS n, x FROM (
    SELECT item_id, CASE WHEN len(w) < 13 THEN w ELSE w[s : s + 12] END AS x
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, s, w[s : s + n - 1] AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM places p JOIN windows v USING (n, x)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_source_mixing": f"""
WITH c AS (SELECT source, count(*) AS n, CASE source {' '.join(f"WHEN '{s}' THEN {w}" for s, w in MIX_WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c)::DOUBLE * w / (SELECT sum(w) FROM c) / n AS rate FROM c),
t AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r)),
f AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM t),
u AS (SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
times AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(f.k) AS times FROM u LEFT JOIN f ON f.source IS NOT DISTINCT FROM u.source AND f.cdf <= u.u AND f.cdf < 1 - 2.220446049250313e-16 GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, mix_copy::INTEGER AS mix_copy, md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy) AS mix_order
FROM (SELECT *, unnest(range(1, times + 1)) AS mix_copy FROM times WHERE times > 0)""",
    "op11_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(x, ' ') AS g FROM (
  SELECT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON n.doc_id = reach.a GROUP BY a""",
    "op9_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    from .oracles import CONVERSATION_REPAIR, PERIODIC_RUNS

    return SQL | {"op12_periodic_runs": PERIODIC_RUNS, "op13_conversation_repair": CONVERSATION_REPAIR}
