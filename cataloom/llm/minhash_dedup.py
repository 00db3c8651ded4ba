"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is the multiset of its five-word shingles, each weighing its count times a damped inverse document frequency. A sample of
the improved scheme is a (shingle, level) pair that two texts share with the probability of their weighted Jaccard similarity.
SAMPLES of them make a signature; texts that agree on all ROWS samples of a band meet in a bucket.

A bucket never gives all its pairs. Its most central text, the hub, is compared with every other, and what is similar to the hub is
linked to it. Let m be the weight of the hub's shingles that a text lacks, e that of its shingles that the hub lacks, and w the hub's
weight. With THRESHOLD t and p = t / (1 + t), a text costs (1 - p) m + p e; it is similar to the hub if that is (1 - 2p) w or less, and
two texts are similar if and only if they differ from the hub alike (lack the same, have the same more) in a weight of

    need = (their costs) - (1 - 2p) w

or more. Two texts of which one isn't similar to the hub so have a difference in common that, in any order of differences, has a
weight of need or more from there on in both texts (a prefix filter). Only pairs with such a difference are made, so nothing similar
is lost within a bucket. 1 - J is a metric: if one of a pair is below LOW to the hub, the other is below HIGH = LOW + 1 - THRESHOLD.
Texts below HIGH meet again under a next hub, and after the last of ROUNDS they are paired with an empty hub, which makes the rule
above the prefix filter of all their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, mix64, small_batches, texts_of, windows, word_hashes, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
ROUNDS = 3
#: Texts with LOW or more to a hub are paired by their differences from it; those below HIGH meet under a next hub.
LOW = 0.5
HIGH = LOW + 1 - THRESHOLD
#: The share p of the weight of both texts that similar texts have in common, see above.
SHARE = THRESHOLD / (1 + THRESHOLD)
#: A pair is verified if it shares so much of its signature: five standard deviations below THRESHOLD, or LOW for pairs with a hub.
SURE, SURE_LOW = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SAMPLES), LOW - 4 * math.sqrt(LOW * (1 - LOW) / SAMPLES)
#: Under a hub with LARGE texts or more, differences that a part of 1 / COMMON of them have are the last in order.
LARGE, COMMON = 16, 8
#: Sums of weights are compared with this tolerance.
EPSILON = 1e-6
#: Partners of a text that one group of rows holds at most, about; the text is sent once to each group.
PARTNERS = 256
#: Shingles in this share of the documents or more have a lower weight, at most by DAMPING. There are at most (shingles per
#: document) / FREQUENT of them, however many documents there are, so their table can be broadcast.
FREQUENT, DAMPING = 0.01, 0.1
#: Candidates for frequent shingles are sent to the tasks up to this number; beyond, all shingles are counted by shuffle.
SENT_CANDIDATES = 2_000_000
BATCH_BYTES = 2 << 20
#: Shingles among which a task looks for candidates at a time.
CHUNK_SHINGLES = 4_000_000


# --- shingles ------------------------------------------------------------------------------------------------------------


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, how often each occurs, and each text's first place (one more at the end).

    A text of fewer words, but not none, is one shingle.
    """
    hashes, first = word_hashes(texts)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    gram = windows(hashes, SHINGLE)
    at = np.flatnonzero(owner[: len(gram)] == owner[SHINGLE - 1 :]) if len(gram) else np.empty(0, np.int64)
    gram, owner_of = gram[at], owner[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        whole = np.array([windows(hashes[first[i] : first[i + 1]], int(n[i]))[0] for i in short], np.uint64)
        gram, owner_of = np.concatenate((gram, whole)), np.concatenate((owner_of, short))
    order = np.lexsort((gram, owner_of))
    gram, owner_of = gram[order], owner_of[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner_of[1:] != owner_of[:-1])
    heads = np.flatnonzero(fresh)
    return gram[heads], np.diff(np.append(heads, len(gram))), np.searchsorted(owner_of[heads], np.arange(len(texts) + 1))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in FREQUENT or more of all documents, and their weights.

    What is frequent over all is frequent in some part, so each task names what is frequent in its part, and the named ones are
    counted over all documents.
    """
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch], least: bool, only: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = n = 0

        def out() -> pa.RecordBatch:
            every = np.concatenate([*held, np.empty(0, np.uint64)])
            held.clear()
            # sorted in place: np.unique takes several times the memory
            every.sort()
            heads = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            h, c = every[heads], np.diff(np.append(heads, len(every)))
            if least:
                keep = c >= math.ceil(FREQUENT * n)
                h, c = h[keep], c[keep]
            # a row without hash tells the number of documents
            return pa.record_batch([pa.array([None, *h.astype(np.int64).tolist()], pa.int64()), pa.array([n, *c.tolist()], pa.int64())], names=["h", "n"])

        for part in by_bytes(batches, "t", BATCH_BYTES):
            h, _, first = shingles(texts_of(part.column("t")))
            n += int((np.diff(first) > 0).sum())
            if only is not None:
                place = np.minimum(np.searchsorted(only, h), len(only) - 1)
                h = h[only[place] == h]
            held.append(h)
            size += len(h)
            if size >= CHUNK_SHINGLES:
                yield out()
                size = n = 0
        if n:
            yield out()

    texts = docs.select("t")
    named = written(texts.mapInArrow(lambda b: counted(b, True, None), "h long, n long"), "shingle-candidates")
    total = named.filter("h IS NULL").agg(F.sum("n")).first()[0] or 0
    candidates = written(named.filter("h IS NOT NULL").select("h").distinct(), "shingle-names")
    n = candidates.count()
    if not n:
        return np.empty(0, np.uint64), np.empty(0)
    if n <= SENT_CANDIDATES:
        sent = spark.sparkContext.broadcast(np.sort(candidates.toPandas()["h"].to_numpy(np.int64).astype(np.uint64)))
        counts = texts.mapInArrow(lambda b: counted(b, False, sent.value), "h long, n long").filter("h IS NOT NULL")
    else:
        counts = texts.mapInArrow(lambda b: counted(b, False, None), "h long, n long").join(candidates, "h", "left_semi")
    least = max(FREQUENT * total, 2)
    found = counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()
    h, df = found["h"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.float64)
    order = np.argsort(h)
    span = math.log(total / least) if total > least else 1.0
    return h[order], (1 - DAMPING * np.log(df / least) / span)[order]


def weights_of(h: np.ndarray, tf: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Count times inverse document frequency; the latter is 1 for all but frequent shingles."""
    w = tf.astype(np.float64)
    names, idf = frequent
    if len(names):
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        hit = names[at] == h
        w[hit] *= idf[at[hit]]
    return w


# --- signatures ----------------------------------------------------------------------------------------------------------

_TABLE_BITS = 16


def _ordered(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit floats that sort as they do, in the upper half of 64 bits."""
    b = x.astype(np.float32).view(np.uint32)
    return np.where(b >> 31, ~b, b | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


class Sampler:
    """The random variables of improved consistent weighted sampling, drawn from a table by the hash of shingle and sample."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        size = 1 << _TABLE_BITS
        self.r, log_c, self.beta = r.gamma(2, 1, size), np.log(r.gamma(2, 1, size)), r.random(size)
        self.log_c = log_c
        # with weight 1 the level is 0, and only the shingle counts
        self.unit = _ordered(log_c + self.r * self.beta - self.r)
        self.odd = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
        self.shift = mix64(np.arange(101, SAMPLES + 101, dtype=np.uint64))

    def signatures(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """SAMPLES numbers of 32 bits for each text with shingles: those at least, (ln a) = ln c - r (t - beta) - r with level
        t = floor(ln w / r + beta)."""
        starts = first[:-1][np.diff(first) > 0]
        out = np.empty((len(starts), SAMPLES), np.uint32)
        low = mix64(h) & np.uint64(0xFFFFFFFF)
        odd = np.flatnonzero(w != 1)
        log_w = np.log(w[odd])
        for j in range(SAMPLES):
            at = ((h + self.shift[j]) * self.odd[j]) >> np.uint64(64 - _TABLE_BITS)
            key = self.unit[at] | low
            if len(odd):
                a = at[odd]
                r, beta = self.r[a], self.beta[a]
                t = np.floor(log_w / r + beta)
                level = (low[odd] + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
                key[odd] = _ordered(self.log_c[a] - r * (t - beta) - r) | level
            out[:, j] = np.minimum.reduceat(key, starts).astype(np.uint32) if len(starts) else out[:, j]
        return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, band number included."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.astype(np.int64)


def _signed(docs: DataFrame, frequent: Broadcast) -> DataFrame:
    """(x, sig, bands) of each text with words; x is the hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for part in by_bytes(batches, "t", BATCH_BYTES):
            h, tf, first = shingles(texts_of(part.column("t")))
            some = np.flatnonzero(np.diff(first) > 0)
            if not len(some):
                continue
            sig = sampler.signatures(h, weights_of(h, tf, frequent.value), first)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band_keys(sig).ravel()))
            yield pa.record_batch([part.column("x").take(pa.array(some)), pa.array([s.tobytes() for s in sig], pa.binary()), bands], names=["x", "sig", "bands"])

    return docs.select("x", "t").mapInArrow(run, "x long, sig binary, bands array<long>")


# --- pairs ---------------------------------------------------------------------------------------------------------------


def _likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of least or more."""
    sig = signatures.select("x", "sig")
    both = pairs.select("a", "b").distinct().join(sig.select(F.col("x").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("x").alias("b"), F.col("sig").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SAMPLES) for c in ("sa", "sb"))
            keep = pa.array((sa == sb).mean(1) >= least)
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def elements(texts: list[bytes], frequent: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text as a set: the sorted names of its shingles, with another name for each further occurrence, and their weights."""
    h, tf, first = shingles(texts)
    idf = weights_of(h, np.ones(len(h)), frequent)
    if (tf > 1).any():
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        of = np.repeat(np.arange(len(h)), tf)
        nth = (np.arange(len(of)) - np.repeat(np.cumsum(tf) - tf, tf)).astype(np.uint64)
        names = np.where(nth > 0, mix64(h[of] + nth * np.uint64(0x9E3779B97F4A7C15)), h[of])
        order = np.lexsort((names, owner[of]))
        first = np.searchsorted(owner[of], np.arange(len(texts) + 1))
        h, idf = names[order], idf[of][order]
    return [(h[i:j], idf[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts as elements() gives them; 0 if both are empty."""
    shared = float(a[1][_held(a[0], b[0])].sum())
    return shared / max(float(a[1].sum()) + float(b[1].sum()) - shared, EPSILON)


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a the sorted b has."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def differences(x: tuple[np.ndarray, np.ndarray], hub: tuple[np.ndarray, np.ndarray]) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The part of x in need, half of the hub's included, and that half; and the differences of x from the hub with their weights:
    first what only x has, then the complements of what only the hub has, the rarest first."""
    more, less = ~_held(x[0], hub[0]), ~_held(hub[0], x[0])
    half = (1 - 2 * SHARE) * float(hub[1].sum()) / 2
    cost = (1 - SHARE) * float(hub[1][less].sum()) + SHARE * float(x[1][more].sum())
    sides = []
    for names, w in ((x[0][more], x[1][more]), (~hub[0][less], hub[1][less])):
        order = np.lexsort((names, -w))
        sides.append((names[order], w[order]))
    names, w = (np.concatenate(p) for p in zip(*sides, strict=True))
    return cost - half, half, names.astype(np.int64), w


def prefix(part: float, half: float, names: np.ndarray, w: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the differences at which a shared prefix can begin, with the weight from there on; common ones are the last in order."""
    if len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common[order], names), len(common) - 1)
        later = np.argsort(np.where(common[order][at] == names, order[at] + 1, 0), kind="stable")
        names, w = names[later], w[later]
    tail = np.cumsum(w[::-1])[::-1]
    # a partner that shares need has a cost of SHARE * need or more; a text similar to the hub is only paired with one that isn't
    least = (part - half) / (1 - SHARE) if part > half else part + half
    keep = tail >= least - EPSILON
    return names[keep], tail[keep]


FOUND = "a long, b long, j double, part double, half double, names array<long>, weights array<double>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "b", "j", "part", "half", "names", "weights"])


def _verified(pairs: DataFrame, texts: DataFrame, frequent: Broadcast, least: float, differ: bool = False) -> DataFrame:
    """(a, b, j, part, half, names, weights) for distinct pairs with a weighted Jaccard similarity j of least or more, from their
    whole texts; the last four are the differences of a from b if asked for, else null.

    Rows are dealt by b and a number, so that a task reads b's text once and then streams those of its partners.
    """
    groups = F.ceil(F.col("n") / PARTNERS).cast("int")
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    body = pairs.join(counts, "b").select("b", F.pmod(F.xxhash64("a"), groups).cast("int").alias("part"), "a")
    # texts are shuffled at every size, rather than sent to where a small table of pairs is, so that plans stay alike
    body = body.join(texts.select(F.col("x").alias("a"), "t").hint("merge"), "a").select("b", "part", "a", "t")
    heads = counts.join(texts.select(F.col("x").alias("b"), "t").hint("merge"), "b").select("b", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "t")
    rows = heads.union(body).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in by_bytes(batches, "t", BATCH_BYTES):
            out = []
            for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), elements(texts_of(batch.column("t")), frequent.value), strict=True):
                if a is None:
                    hub = x
                elif (j := weighted_jaccard(x, hub)) >= least - 1e-12:
                    out.append((a, b, j, *(differences(x, hub) if differ else [None] * 4)))
            yield _found(out)

    return rows.mapInArrow(run, FOUND)


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(x, label) for each of nodes (x, met): a text within two links of it, the one that met most. Equal labels so mean one class."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = nodes.select("x", F.struct("met", F.col("x").alias("of")).alias("label"))
    for _ in range(2):
        near = both.join(label.select(F.col("x").alias("b"), "label"), "b").select(F.col("a").alias("x"), "label")
        label = written(label.union(near).groupBy("x").agg(F.max("label").alias("label")), "labels")
    return label.select("x", F.col("label.of").alias("label"))


def _tops(tested: DataFrame, nodes: DataFrame) -> DataFrame:
    """(x, top): of the hubs with LOW or more that a text was compared with, the one that met most."""
    return tested.select(F.col("a").alias("x"), "b").join(nodes.select(F.col("x").alias("b"), "met"), "b").groupBy("x").agg(F.max(F.struct("met", "b"))["b"].alias("top"))


def _common(rows: DataFrame) -> DataFrame:
    """(b, common) from the differences (b, n, names) of a hub's n texts: those that many have, the most common last.

    A task counts among its own texts and reports what a part of 1 / COMMON of them have, so common is short: 2 * COMMON times the
    differences of a text at most. It only says what goes last in order, and any such list gives the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, n, names = np.asarray(batch.column("b")), np.asarray(batch.column("n")), _lists(batch.column("names"))
            hubs, first, hub, texts = np.unique(b, return_index=True, return_inverse=True, return_counts=True)
            owner, flat = np.repeat(hub, [len(x) for x in names]), np.concatenate(names) if names else np.empty(0, np.int64)
            order = np.lexsort((flat, owner))
            owner, flat = owner[order], flat[order]
            heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (flat[1:] != flat[:-1]))[: len(flat)])
            often = np.diff(np.append(heads, len(flat)))
            keep = (often > 1) & (often * COMMON >= texts[owner[heads]])
            at = owner[heads][keep]
            yield pa.record_batch([pa.array(hubs[at]), pa.array(n[first][at]), pa.array(flat[heads][keep]), pa.array(often[keep])], names=["b", "n", "s", "many"])

    found = rows.sortWithinPartitions("b").mapInArrow(run, "b long, n long, s long, many long").groupBy("b", "n", "s").agg(F.sum("many").alias("many"))
    return found.filter(F.col("many") * 2 * COMMON >= F.col("n")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("many", "s")))["s"].alias("common"))


def _alike(found: DataFrame, labels: DataFrame, tops: DataFrame, turn: int) -> DataFrame:
    """(a, b) under one hub b of found (a, b, j, part, half, names, weights, turn): pairs, not both similar to it, that can be similar.

    Pairs of earlier turns aren't made again. Those with one label (x, label) aren't needed: links hold them together already. Those
    with one top (x, top) are decided by their differences from it, and made under no other hub.
    """
    marked = found.join(labels.withColumnRenamed("x", "a"), "a").join(tops.withColumnRenamed("x", "a"), "a", "left")
    # under the other hubs there is no such pair
    ends = [f(c).alias(name) for f, c, name in ((F.count, "a", "n"), (F.min, "j", "low"), (F.max, "turn", "late"), (F.min, "label", "one"), (F.max, "label", "other"))]
    hubs = written(marked.groupBy("b").agg(*ends).filter((F.col("low") < THRESHOLD) & (F.col("late") == turn) & (F.col("one") != F.col("other"))).select("b", "n"), "open-hubs")
    rows = marked.join(hubs, "b", "left_semi")
    common = _common(rows.select("b", "names").join(hubs.filter(F.col("n") >= LARGE), "b"))
    rows = rows.join(written(common, "common-differences"), "b", "left").select("b", "a", "label", "top", "part", "half", "names", "weights", "common", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_lists(batch.column(c)) for c in ("names", "weights", "common")]
            parts, halves = batch.column("part").to_pylist(), batch.column("half").to_pylist()
            got = [prefix(p, h, *x) for p, h, *x in zip(parts, halves, *lists, strict=True)]
            kept = [pa.array([g[i] for g in got], pa.list_(kind)) for i, kind in ((0, pa.int64()), (1, pa.float64()))]
            rest = pa.array([p > h for p, h in zip(parts, halves, strict=True)], pa.bool_())
            yield pa.record_batch([*(batch.column(c) for c in ("b", "a", "label", "top", "part", "turn")), rest, *kept], names=["hub", "x", "label", "top", "part", "turn", "rest", "names", "tails"])

    rows = rows.mapInArrow(run, "hub long, x long, label long, top long, part double, turn int, rest boolean, names array<long>, tails array<double>")
    rows = rows.select("hub", "x", "label", "top", "part", "rest", "turn", F.explode(F.arrays_zip("names", "tails")).alias("o"))
    rows = written(rows.select("hub", F.col("o.names").alias("s"), "x", "label", "top", "part", F.col("o.tails").alias("tail"), "rest", "turn"), "differences")
    left, right = rows.filter("rest").alias("l"), rows.alias("r")
    met = left.join(right, ["hub", "s"]).filter(f"l.label <> r.label AND (l.top = l.hub OR coalesce(l.top <> r.top, true)) AND (NOT r.rest OR l.x < r.x) AND greatest(l.turn, r.turn) = {turn} AND l.part + r.part <= least(l.tail, r.tail) + {EPSILON}")
    return met.select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct()


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """A view of each list; a null one is empty."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _prefixes(left: DataFrame, texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """What is left of each bucket (bucket, x) in the form of _verified, with the bucket in place of b and an empty hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.uint64), np.empty(0)
        for batch in by_bytes(batches, "t", BATCH_BYTES):
            sets = elements(texts_of(batch.column("t")), frequent.value)
            yield _found([(a, None, 0.0, *differences(x, empty)) for a, x in zip(batch.column("x").to_pylist(), sets, strict=True)])

    rows = texts.join(left.select("x").distinct(), "x", "left_semi").select("x", "t").mapInArrow(run, FOUND)
    return rows.drop("b").join(left.select(F.col("x").alias("a"), F.col("bucket").alias("b")), "a").withColumn("turn", F.lit(0))


def near_duplicate_links(docs: DataFrame) -> DataFrame:
    """(a, b, j): links between the different texts of docs (x, t), x being the hash of text t."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    signatures = written(_signed(docs, frequent).dropDuplicates(["x"]), "signatures")
    members = signatures.select("x", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(members.join(sizes, "bucket"), "bucket-members")
    # how many texts meet a text: the original of a group of copies meets most
    central = written(members.groupBy("x").agg(F.sum("n").alias("met")), "bucket-central")
    left = written(members.join(central, "x").select("bucket", "x", "met"), "bucket-texts")
    texts = written(docs.join(left.select("x").distinct().hint("merge"), "x", "left_semi").dropDuplicates(["x"]), "bucket-contents")
    links: list[DataFrame] = []
    tested = spark.createDataFrame([], f"{FOUND}, turn int")

    def paired(found: DataFrame, turn: int, name: str) -> None:
        linked = links[0].select("a", "b")
        for more in links[1:]:
            linked = linked.union(more.select("a", "b"))
        pairs = written(_likely(_alike(found, _labels(central, linked), _tops(tested, central), turn), signatures, SURE), f"possible-{name}")
        links.append(written(_verified(pairs, texts, frequent, THRESHOLD), f"near-links-{name}").select("a", "b", "j"))

    for turn in range(ROUNDS):
        hubs = left.groupBy("bucket").agg(F.max(F.struct("met", "x"))["x"].alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
        met = written(left.join(written(hubs, f"hubs-{turn}"), "bucket").filter("x <> hub"), f"hub-pairs-{turn}")
        if met.isEmpty():
            left = None
            break
        pairs = met.select(F.col("x").alias("a"), F.col("hub").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = written(_verified(written(_likely(pairs, signatures, SURE_LOW), f"likely-{turn}"), texts, frequent, LOW, differ=True).withColumn("turn", F.lit(turn)), f"hub-links-{turn}")
        links.append(found.filter(F.col("j") >= THRESHOLD).select("a", "b", "j"))
        tested = tested.unionByName(found)
        paired(tested, turn, str(turn))
        known = tested.select(F.col("a").alias("x"), F.col("b").alias("hub"), "j").filter(F.col("j") >= HIGH)
        left = written(met.join(known, ["x", "hub"], "left_anti").select("bucket", "x", "met"), f"bucket-rest-{turn}")
    if left is not None:
        several = left.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
        left = written(left.join(several, "bucket", "left_semi"), "bucket-last")
        if not left.isEmpty():
            paired(_prefixes(left, texts, frequent), 0, "last")
    out = links[0] if links else tested.select("a", "b", "j")
    for more in links[1:]:
        out = out.unionByName(more)
    return out.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max("j").alias("j"))


def _classed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(k, x, root) for each row of docs, x being the hash of its text and root that of its class's lowest text; and the links."""
    small_batches(docs.sparkSession)
    x = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).alias("k"), x.alias("x"), F.col(text).alias("t"))
    links = written(near_duplicate_links(rows.select("x", "t")), "near-links")
    roots = written(components(links.select("a", "b")), "near-roots")
    return written(rows.select("k", "x").join(roots, F.col("x") == F.col("v"), "left").select("k", "x", F.coalesce("root", "x").alias("root")), "near-ids"), links


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size, n_links), a row for each row of docs: classes of exact and near copies.

    class_id is the lowest key of the class; class_size counts rows; n_links counts the other texts to which the row's text was
    found linked: with similarity THRESHOLD or more. Links are between different texts; rows with equal texts (null as empty)
    are one class without being paired. Classes are the connected components of links, and not every pair of a class was
    compared. A text of fewer than five words is one shingle; a text without words has no near copies. A null key is lowest.
    Repeated rows are copies. An empty table gives an empty table; other columns aren't read.
    """
    ids, links = _classed(docs, key, text)
    degree = links.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
    # a null key is lowest, so min() must see it
    lowest = ids.groupBy("root").agg(F.min(F.struct(F.col("k").isNotNull().alias("known"), "k"))["k"].alias("class_id"), F.count("*").alias("class_size"))
    lowest = written(lowest, "near-classes")
    return ids.join(lowest, "root").join(degree, F.col("x") == F.col("v"), "left").select(F.col("k").alias(key), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with their columns, one for each class of near_duplicates, whatever the keys: the one with the lowest key, a
    null key being lowest, and of rows with that key the one with the lowest hash of the text. Of rows with that key and text, one
    stays, chosen by a hash of all its columns. An empty table gives an empty table."""
    ids, _ = _classed(docs, key, text)
    # by root, so that no two classes share a row, though their keys are null or repeat
    keep = ids.groupBy("root").agg(F.min(F.struct(F.col("k").isNotNull().alias("known"), "k", "x")).alias("low")).select("low.k", "low.x")
    others = F.struct(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c != text)).cast("string")
    packed = docs.select(F.struct("*").alias("doc"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("x"), F.xxhash64(others, F.col(text)).alias("tie"))
    first = packed.join(keep, packed["k"].eqNullSafe(keep["k"]) & (packed["x"] == keep["x"]), "left_semi").groupBy("x").agg(F.min_by("doc", "tie").alias("doc"))
    return first.select("doc.*")
