"""Periodic run detection on grammar-compressed word sequences.

The word ids of a text are compressed by Re-Pair: the most frequent pairs become nonterminals, in rounds that replace all pairs of which
none beside it is more frequent, so that rules are as balanced as the text allows. What is left at the end is joined by a balanced tree
of rules. A run lies within the expansion of some lowest nonterminal whose boundary it crosses, and there it has its whole extent. So
the stretches that cross each nonterminal's boundary are computed once, translated to all places where it is derived, and of the
intervals of one period those that no other contains are the runs.

A run has LEAST words and POWER periods or more, so each five words of it come twice or more in the text, and each of its words lies in
such a window. Stretches of words in windows that repeat are compressed one by one; what lies between them is in no run. Windows are
compared by hashes (equal ones of different words add words to a stretch, no more), words by their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, texts_of, windows

#: A run has so many words, and so many times its period, or more.
LEAST, POWER = 6, 4
#: Words of the windows that must repeat: (POWER * q - 4) / q >= 2 windows of each phase for a period q >= 2, and two for q = 1.
WINDOW = 5
BATCH_BYTES = 2 << 20


# --- Re-Pair -------------------------------------------------------------------------------------------------------------


def re_pair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, size): the rules of a grammar whose last nonterminal derives ids, and the length of each symbol's expansion.

    Symbols below len(size) - len(left) are the ids themselves, which must be 0, 1, ...; rule i makes the symbol that follows them by i.
    """
    terminals = int(ids.max()) + 1
    seq, lefts, rights, total = ids.astype(np.int64), [], [], terminals
    while len(seq) > 1:
        pair = seq[:-1] * total + seq[1:]
        codes, of, count = np.unique(pair, return_inverse=True, return_counts=True)
        if count.max() < 2:
            break
        # rank of the pairs: by count, then by a hash, so that ties are broken alike wherever a pair comes
        rank = np.empty(len(codes), np.int64)
        rank[np.lexsort(((codes * 0x9E3779B1) & 0xFFFFFFFF, count))] = np.arange(len(codes))
        rank[count < 2] = -1
        at = rank[of]
        chosen = at >= 0
        chosen[1:] &= at[1:] >= at[:-1]
        chosen[:-1] &= at[:-1] >= at[1:]
        # a symbol that repeats makes equal pairs side by side: each second one counts, from the first on
        place = np.flatnonzero(chosen)
        new = np.ones(len(place), bool)
        new[1:] = np.diff(place) > 1
        start = place[new][np.cumsum(new) - 1]
        place = place[(place - start) % 2 == 0]
        used, fresh = np.unique(of[place], return_inverse=True)
        lefts.append(codes[used] // total)
        rights.append(codes[used] % total)
        seq[place] = total + fresh
        seq = np.delete(seq, place + 1)
        total += len(used)
    while len(seq) > 1:
        n = len(seq) // 2
        lefts.append(seq[0 : 2 * n : 2])
        rights.append(seq[1 : 2 * n : 2])
        seq = np.concatenate((np.arange(total, total + n), seq[2 * n :]))
        total += n
    left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (lefts, rights))
    size = np.ones(total, np.int64)
    for i in range(len(left)):
        size[terminals + i] = size[left[i]] + size[right[i]]
    return left, right, size


# --- runs ----------------------------------------------------------------------------------------------------------------


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, step, done = min(len(a), len(b)), 16, 0
    while done < n:
        end = min(done + step, n)
        differ = a[done:end] != b[done:end]
        if differ.any():
            return done + int(differ.argmax())
        done, step = end, step * 4
    return n


def _squares(v: np.ndarray) -> Iterator[tuple[int, int]]:
    """(p, length): the prefix of v with period p and 2 p words or more, for each p that isn't a multiple of a lower one."""
    n = len(v)
    starts = np.flatnonzero(v[1 : n // 2 + 1] == v[0]) + 1
    for d in (1, 2, 3):  # most starts end here
        starts = starts[(v[np.minimum(starts + d, n - 1)] == v[min(d, n - 1)]) | (starts <= d)]
    beyond = 0
    for p in starts.tolist():
        if p <= beyond:
            continue
        length = _common(v, v[p:]) + p
        if length >= 2 * p:
            yield p, length
            beyond = length // 2  # up to there only multiples of p are periods of a square


def crossing(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches of u v that cross the boundary and have LEAST words and POWER periods or more, as far as
    u v goes, by their smallest periods.

    One side of the boundary holds two periods or more, so it begins, or ends, with a square of the period.
    """
    found: dict[tuple[int, int], int] = {}
    b, whole = len(u), None
    for mirrored in (False, True):
        x, y = (u[::-1], v[::-1]) if mirrored else (v, u)  # x holds the square; y is on the other side
        if len(x) < 2:
            continue
        for p, length in _squares(x):
            if whole is None:
                whole = np.concatenate((u, v))
            if mirrored:  # from the square at the end of u on, to the right
                begin, end = b - length, b + _common(v, whole[b - p :])
            else:
                begin, end = b - _common(u[::-1], whole[: b + p][::-1]), b + length
            if begin < b < end and end - begin >= max(LEAST, POWER * p):
                found[begin, end] = min(p, found.get((begin, end), p))
    return [(s, e, p) for (s, e), p in found.items()]


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ids (0, 1, ...), by start and period."""
    if len(ids) < LEAST:
        return []
    left, right, size = re_pair(ids)
    t = len(size) - len(left)
    held: dict[int, list[tuple[int, int, int]]] = {}
    # where each symbol's expansion stands in ids: the first derivation, from the last rule down
    first = np.full(len(size), -1, np.int64)
    first[-1] = 0
    for i in range(len(left) - 1, -1, -1):
        at = first[t + i]
        if first[left[i]] < 0:
            first[left[i]] = at
        if first[right[i]] < 0:
            first[right[i]] = at + size[left[i]]
    for i in range(len(left)):
        s = t + i
        if size[s] < LEAST:
            continue
        at, mid = int(first[s]), int(first[s] + size[left[i]])
        if got := crossing(ids[at:mid], ids[mid : at + int(size[s])]):
            held[s] = got
    if not held:
        return []
    # only nonterminals that derive one with a stretch are followed to all their places
    inside = np.zeros(len(size), bool)
    inside[list(held)] = True
    for i in range(len(left)):
        inside[t + i] |= inside[left[i]] | inside[right[i]]
    places: dict[int, list[np.ndarray]] = {len(size) - 1: [np.zeros(1, np.int64)]}
    out = []
    for s in range(len(size) - 1, t - 1, -1):
        if s not in places or not inside[s]:
            continue
        at = np.concatenate(places.pop(s))
        for begin, end, p in held.get(s, ()):
            out.append(np.stack((np.full(len(at), p), at + begin, at + end)))
        for child, shift in ((int(left[s - t]), 0), (int(right[s - t]), int(size[left[s - t]]))):
            if inside[child]:
                places.setdefault(child, []).append(at + shift)
    period, start, end = np.concatenate(out, axis=1)
    order = np.lexsort((-end, start, period))
    period, start, end = period[order], start[order], end[order]
    # of one period, an interval stays if it ends beyond all that began before it
    stretch = int(end.max()) + 1
    reach = np.maximum.accumulate(period * stretch + end)
    keep = np.ones(len(order), bool)
    keep[1:] = (period * stretch + end)[1:] > reach[:-1]
    got = sorted(zip(start[keep].tolist(), (end - start)[keep].tolist(), period[keep].tolist(), strict=True), key=lambda r: (r[0], r[2]))
    return got


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches of words that lie in windows which come twice or more, with LEAST words or more."""
    gram = windows(hashes, WINDOW)
    if len(gram) < 2:
        return []
    ordered = np.sort(gram)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, gram), len(twice) - 1)
    again = np.flatnonzero(twice[at] == gram)
    breaks = np.flatnonzero(np.diff(again) > WINDOW)
    begins, ends = again[np.append(0, breaks + 1)], again[np.append(breaks, len(again) - 1)] + WINDOW
    long = ends - begins >= LEAST
    return list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))


def runs_of_words(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a text's words, by start and period."""
    if len(words) < LEAST:
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    out = []
    for begin, end in stretches(hashes):
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words[begin:end]), np.int64, end - begin)
        out += [(begin + s, n, p) for s, n, p in runs_of(ids)]
    return out


def made_periodic(words: list[bytes], key: object) -> list[bytes]:
    """The words with a periodic end for a tenth of the keys: h = crc32 of the decimal key, g = h // 10; if h % 10 is 0, word i from
    a = g % n on is word a + (i - a) % p with p = 1 + (n - a) // (3 + g % 8). A null key leaves them as they are."""
    n = len(words)
    if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * times + words[a : a + rest]


# --- Spark ---------------------------------------------------------------------------------------------------------------

_FIELDS = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", periodic_by_key: bool = False) -> DataFrame:
    """(key, n_words, runs, collapsed), a row for each row of docs: maximal runs of words by start and period, and the text's words,
    joined by one space, without those that a run has after its first period.

    Words are separated by ASCII white space and numbered from 0. Each text is read whole, by one task, which holds a few MB of other
    texts beside it. A null or empty text has no words, no runs and an empty collapsed text. periodic_by_key first makes the texts of a
    tenth of the keys periodic (made_periodic), for tests of this operator. Rows that repeat stay, a null key is a key. An empty table
    gives an empty table; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = f"k {rows.schema[0].dataType.simpleString()}, {_FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for part in by_bytes(batches, "t", BATCH_BYTES):
            n, runs, collapsed = [], [], []
            for k, t in zip(part.column("k").to_pylist(), texts_of(part.column("t")), strict=True):
                words = t.split()
                if periodic_by_key:
                    words = made_periodic(words, k)
                found = runs_of_words(words)
                n.append(len(words))
                runs.append([{"start": s, "length": length, "period": p} for s, length, p in found])
                if found:
                    gone = bytearray(len(words))
                    for s, length, p in found:
                        gone[s + p : s + length] = b"\x01" * (length - p)
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                collapsed.append(b" ".join(words).decode())
            yield pa.record_batch([part.column("k"), pa.array(n, pa.int64()), pa.array(runs, struct), pa.array(collapsed, pa.string())], names=["k", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, kind).withColumnRenamed("k", key)


def run_digests(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Of periodic_runs: (key, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256). The run that is named has
    the greatest length / period, then the lowest start and period; exponents are compared as fractions."""
    better = lambda a, b: F.when(a["period"].isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    none = F.struct(*(F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")))
    best = F.aggregate("runs", none, better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", best)
    named = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("best.length * 1000 div best.period").cast("long")
    return rows.select(key, F.size("runs").cast("long").alias("n_runs"), *named, exponent.alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
