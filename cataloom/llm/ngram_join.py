"""N-gram Jaccard join by set-relation skipping; its answer is the connected component of each document's set.

A document is the set of its distinct five-word shingles; sets link at a Jaccard similarity of 0.8 or more. Equal sets are one set from
the start. Shingles have one order over the corpus, rare ones first, so that similar sets share a shingle of their prefixes, and an index
list for each prefix shingle holds the sets with their positions in order.

*Answers are derived from a highly similar set.* Each set is compared with the hub of its lists by least hashes, the set that meets most
others. What is linked with a hub has the hub's answer: it needs none of its own within that component, and lists that lie in one
component are skipped. Large lists of several components go on in the same way: two sets that were compared with one hub are similar if
and only if they differ from it alike in enough shingles, so their overlap comes from their differences from the hub, not from their
sets, and only sets with a shared difference in a prefix of their differences are paired (see minhash_dedup).

*Index lists are skipped by position.* The rest of the lists is sorted by position. Of sets of nx and ny shingles, linked if they share
need = 4 (nx + ny) / 9 or more, with the shared shingle at positions i and j, at most min(nx - i, ny - j) shingles from there on are shared,
and |i - j| can't exceed nx + ny - 2 need; beyond a difference of nx / 4 the rest of a list is skipped at once. Surviving pairs are bounded
by the overlap of their prefixes and verified on their whole sets. No step loses a link, so components are exact.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, mix64, shared_dir, small_batches, texts_of, windows, word_hashes, written
from .components import components
from .minhash_dedup import FOUND, HIGH, LOW, ROUNDS, THRESHOLD, _alike, _found, _held, _tops, differences

SHINGLE = 5
#: Counters of shingles, by the upper bits of their hashes; their number is fixed, whatever the corpus, and so is what is broadcast.
COUNTER_BITS, SLICE_BITS = 20, 16
#: Least hashes of a set by which it finds its hub, and how many of them it must share with it to be compared.
LEAD, LEAD_SHARED = 8, 3
#: Index lists up to this length are compared within the list, longer ones by hubs.
SHORT = 64
#: Components with more sets than this, and than a part of 1 / HOT_PARTS of all, are hot: there are HOT_PARTS of them at most.
HOT, HOT_PARTS = 1000, 1000
#: Partners of a set that one group of rows holds at most, about; the set's text is sent once to each group.
PARTNERS = 256
BATCH_BYTES = 2 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def linked(shared: int, a: int, b: int) -> bool:
    """Whether sets of a and b shingles that share so many are linked: 100 * shared >= 80 * union."""
    return 5 * shared >= 4 * (a + b - shared)


def prefix_length(n: int) -> int:
    """How many of n shingles, in order, a set of similarity THRESHOLD or more can't all lack: n - ceil(0.8 n) + 1."""
    return n - -(-4 * n // 5) + 1 if n else 0


# --- sets ----------------------------------------------------------------------------------------------------------------


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles, A-Z in lower case; a text of fewer words, but not none, is one shingle."""
    hashes, first = word_hashes([t.translate(_LOWER) for t in texts])
    gram, out = windows(hashes, SHINGLE), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        h = gram[a : b - SHINGLE + 1] if n >= SHINGLE else windows(hashes[a:b], n) if n else gram[:0]
        h = np.sort(h)
        if len(h) > 1:
            keep = np.ones(len(h), bool)
            np.not_equal(h[1:], h[:-1], out=keep[1:])
            h = h[keep]
        out.append(h)
    return out


def set_hash(h: np.ndarray) -> int:
    """64 bits of a set, as a signed number."""
    return int(mix64(np.array([mix64(h).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).astype(np.int64)[0])


def _sets(docs: DataFrame) -> DataFrame:
    """(k, x, n, lead, slice, counts): the hash x and size n of each row's set and its least hashes; and for each task rows with the
    counts of its shingles, in slices of counters (n is null there)."""
    kind = f"k {docs.schema['k'].dataType.simpleString()}, x long, n long, lead array<long>, slice int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.uint32)
        names, lists, some, key = ["k", "x", "n", "lead", "slice", "counts"], pa.list_(pa.int64()), False, None
        for part in by_bytes(batches, "t", BATCH_BYTES):
            sets = sets_of(texts_of(part.column("t")))
            key, m = part.column("k").type, len(sets)
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            np.add.at(counts, (flat >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            some |= len(flat) > 0
            yield pa.record_batch([part.column("k"), pa.array([set_hash(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array([h[:LEAD].astype(np.int64) for h in sets], lists), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if some:
            for i, piece in enumerate(np.split(counts, 1 << (COUNTER_BITS - SLICE_BITS))):
                packed = pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())
                yield pa.record_batch([pa.nulls(1, key), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, lists), pa.array([i], pa.int32()), packed], names=names)

    return docs.mapInArrow(run, kind)


def _ranks(counted: DataFrame) -> np.ndarray:
    """A 16-bit rank for each counter, from its sum over all tasks: higher where shingles are more frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
        for i, s in sums.items():
            # 40 bits of counts in steps of 0.06 %
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([(np.log1p(s) * 1600).astype(np.uint16).tobytes()], pa.binary())], names=["slice", "ranks"])

    out = np.zeros(1 << COUNTER_BITS, np.uint16)
    slices = 1 << (COUNTER_BITS - SLICE_BITS)
    for r in counted.repartition(slices, "slice").mapInArrow(run, "slice int, ranks binary").toLocalIterator():
        out[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["ranks"], np.uint16)
    return out


def ordered(h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Names of shingles that sort by their order over the corpus: their rank, then their hash."""
    rank = ranks[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64)
    # shifted by one bit, so that the order holds for signed numbers
    return np.sort(((rank << np.uint64(48)) | (h >> np.uint64(16))) >> np.uint64(1)).astype(np.int64)


def _prefixes(docs: DataFrame, ranks: Broadcast, roots: DataFrame) -> DataFrame:
    """(x, n, p, root): each set once, with its prefix in order and its root; null for a set that is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "t", BATCH_BYTES):
            sets = [h for h in sets_of(texts_of(part.column("t"))) if len(h)]
            p = [ordered(h, ranks.value)[: prefix_length(len(h))] for h in sets]
            yield pa.record_batch([pa.array([set_hash(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int32()), pa.array(p, pa.list_(pa.int64()))], names=["x", "n", "p"])

    # grouped and joined by x in one shuffle
    once = docs.mapInArrow(run, "x long, n int, p array<long>").groupBy("x").agg(F.first("n").alias("n"), F.first("p").alias("p"))
    return once.join(roots.hint("merge"), "x", "left")


# --- texts on their way --------------------------------------------------------------------------------------------------


def packed(texts: list[bytes]) -> pa.Array:
    """The texts by zstd, each behind its length. They are shuffled for each comparison, and the blocks of a shuffle are packed less well."""
    codec = pa.Codec("zstd", 1)
    return pa.array([len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts], pa.binary())


def unpacked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts t, which hold about limit bytes each as they were before they were packed."""
    codec = pa.Codec("zstd", 1)
    for batch in by_bytes(batches, "t", limit):
        held = batch.column("t").to_pylist()
        size = [int.from_bytes(x[:8], "little") for x in held]
        group = np.cumsum(size) // limit
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(held)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b > a:
                yield batch.slice(a, b - a), [codec.decompress(x[8:], n, asbytes=True) for x, n in zip(held[a:b], size[a:b], strict=True)]


# --- pairs ---------------------------------------------------------------------------------------------------------------


def _as_lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths())
    return np.split(flat, ends[:-1]) if len(ends) else []


def most_shared(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The most shingles that two sets can share, by their prefixes."""
    end = min(a[-1], b[-1])
    a, b = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
    both = int(_held(a, b).sum())
    return both + min(na - len(a), nb - len(b))


def _possible(pairs: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """The distinct pairs (a, b) whose prefixes allow a similarity of least."""
    side = lambda c: prefixes.select(F.col("x").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_pylist(), batch.column("nb").to_pylist()
            ok = []
            for x, n, y, m in zip(_as_lists(batch.column("pa")), na, _as_lists(batch.column("pb")), nb, strict=True):
                most = most_shared(x, n, y, m) if min(n, m) >= least * max(n, m) - 1e-9 else 0
                ok.append(most >= least * (n + m - most) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _compared(pairs: DataFrame, texts: DataFrame, least: float, differ: bool = False) -> DataFrame:
    """(a, b, j, part, half, names, weights) for distinct pairs with similarity j of least or more, from whole sets; the last four are the
    differences of a from b if asked for. j is THRESHOLD or more if and only if the sets are linked.

    Rows are dealt by b and a number, so that a task reads b's text once and then streams those of its partners.
    """
    groups = F.ceil(F.col("m") / PARTNERS).cast("int")
    counts = pairs.groupBy("b").agg(F.count("*").alias("m"))
    body = pairs.select("a", "b").join(counts, "b").select("b", F.pmod(F.xxhash64("a"), groups).cast("int").alias("part"), "a")
    body = body.join(texts.select(F.col("x").alias("a"), "t").hint("merge"), "a").select("b", "part", "a", "t")
    heads = counts.join(texts.select(F.col("x").alias("b"), "t").hint("merge"), "b").select("b", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "t")
    rows = heads.union(body).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for batch, own in unpacked(batches, BATCH_BYTES):
            out = []
            for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), sets_of(own), strict=True):
                if a is None:
                    hub = x
                    continue
                shared = int(_held(x, hub).sum())
                j = shared / max(len(x) + len(hub) - shared, 1)
                j = max(j, THRESHOLD) if linked(shared, len(x), len(hub)) else min(j, THRESHOLD - 1e-9)
                if j >= least:
                    out.append((a, b, j, *(differences((x, np.ones(len(x))), (hub, np.ones(len(hub)))) if differ else [None] * 4)))
            yield _found(out)

    return rows.mapInArrow(run, FOUND)


def within_lists(token: np.ndarray, x: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of one list and of different roots that can be linked by their sizes and positions.

    Rows are sorted by list and position. Row r is met with r + 1, r + 2, ... until its list ends or the positions differ too much.
    """
    at, d, a, b = np.arange(len(token) - 1), 1, [], []
    while len(at := at[at + d < len(token)]):
        to = at + d
        at = at[(token[at] == token[to]) & ((pos[to] - pos[at]) * 4 <= n[at])]
        to = at + d
        need = -(-4 * (n[at] + n[to]) // 9)
        fits = (root[at] != root[to]) & (5 * np.minimum(n[at], n[to]) >= 4 * np.maximum(n[at], n[to]))
        fits &= (np.minimum(n[at] - pos[at], n[to] - pos[to]) >= need) & (pos[to] - pos[at] <= n[at] + n[to] - 2 * need)
        a.append(x[at[fits]])
        b.append(x[to[fits]])
        d += 1
    return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])


def _place(pos: Column, n: Column, hot: bool) -> Column:
    """One number for a posting, in order of its position."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.shiftleft(n.cast("long"), 1)).bitwiseOR(F.lit(int(hot)).cast("long"))


def _listed(postings: DataFrame) -> DataFrame:
    """(token, a, b) from the postings (token, x, root, place), one token in one task: pairs within short lists (token is null), and the
    members of other lists that may have several roots, as (token, a, null), with a null for the mark of a hot component.

    root is null for a set that is its own; place holds position, size and whether the posting marks a hot component (_place)."""
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings.select("token", "x", "root", "place").repartition(n, "token").sortWithinPartitions("token", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(token: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, hot: np.ndarray | None = None) -> pa.RecordBatch:
            first = pa.array(a, pa.int64(), mask=hot) if hot is not None else pa.array(a, pa.int64())
            none = pa.nulls(len(a), pa.int64())
            return pa.record_batch([none if token is None else pa.array(token, pa.int64()), first, none if b is None else pa.array(b, pa.int64())], names=["token", "a", "b"])

        def closed(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole lists, but for those that were too long before."""
            token, x, size, pos, root, hot = cols
            if not len(token):
                return
            heads = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            m = np.diff(np.append(heads, len(token)))
            several = (np.minimum.reduceat(root, heads) != np.maximum.reduceat(root, heads)) | (token[heads] == long_token)
            long = (m > SHORT) | np.logical_or.reduceat(hot, heads) | (token[heads] == long_token)
            short_rows, long_rows = np.repeat(several & ~long, m), np.repeat(several & long, m)
            a, b = within_lists(*(c[short_rows] for c in (token, x, size, pos, root)))
            yield out(None, a, b)
            yield out(token[long_rows], x[long_rows], None, hot[long_rows])

        held: list[np.ndarray] | None = None
        long_token = None
        for batch in batches:
            token, x, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "x", "place"))
            root = pa.compute.coalesce(batch.column("root"), batch.column("x")).to_numpy(zero_copy_only=False)
            cols = [token, x, (place >> 1) & 0x7FFFFFFF, place >> 32, root, (place & 1) == 1]
            cols = cols if held is None else [np.concatenate(p) for p in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from closed([c[:last] for c in cols])
            held = [c[last:] for c in cols]
            if len(held[0]) > 4 * SHORT:  # a long list is passed on as it comes
                long_token = held[0][0]
                yield from closed(held)
                held = [c[:0] for c in held]
        if held is not None:
            yield from closed(held)

    return rows.mapInArrow(run, "token long, a long, b long")


def _by_hubs(members: DataFrame, prefixes: DataFrame, texts: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """Links (a, b) within the long lists members (bucket, x): all that join two roots (x, root), by hubs and differences from them."""
    spark = members.sparkSession
    sizes = members.groupBy("bucket").agg(F.count("*").alias("m"))
    central = written(members.join(sizes, "bucket").groupBy("x").agg(F.sum("m").alias("met")), "list-central")
    left: DataFrame | None = written(members.join(central, "x").select("bucket", "x", "met"), "list-members")
    labels = written(central.join(roots, "x", "left").select("x", F.coalesce("root", "x").alias("label")), "list-labels")
    links, tested = [], spark.createDataFrame([], f"{FOUND}, turn int")

    def paired(found: DataFrame, turn: int, name: str) -> None:
        pairs = written(_possible(_alike(found, labels, _tops(tested, central), turn), prefixes, THRESHOLD), f"list-pairs-{name}")
        links.append(written(_compared(pairs, texts, THRESHOLD), f"list-links-{name}").select("a", "b"))

    for turn in range(ROUNDS):
        hubs = left.groupBy("bucket").agg(F.max(F.struct("met", "x"))["x"].alias("hub"), F.count("*").alias("m")).filter("m > 1").select("bucket", "hub")
        met = written(left.join(written(hubs, f"list-hubs-{turn}"), "bucket").filter("x <> hub"), f"list-met-{turn}")
        if met.isEmpty():
            return links
        pairs = met.select(F.col("x").alias("a"), F.col("hub").alias("b")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = written(_compared(written(_possible(pairs, prefixes, LOW), f"list-likely-{turn}"), texts, LOW, differ=True).withColumn("turn", F.lit(turn)), f"list-found-{turn}")
        links.append(found.filter(F.col("j") >= THRESHOLD).select("a", "b"))
        tested = tested.unionByName(found)
        paired(tested, turn, str(turn))
        known = tested.select(F.col("a").alias("x"), F.col("b").alias("hub"), "j").filter(F.col("j") >= HIGH)
        left = written(met.join(known, ["x", "hub"], "left_anti").select("bucket", "x", "met"), f"list-rest-{turn}")
    several = left.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket")
    left = written(left.join(several, "bucket", "left_semi"), "list-last")
    if not left.isEmpty():
        paired(_whole_sets(left, texts), 0, "last")
    return links


def _whole_sets(left: DataFrame, texts: DataFrame) -> DataFrame:
    """What is left of each list (bucket, x), as differences from an empty hub, with the bucket in place of the hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.uint64), np.empty(0)
        for batch, own in unpacked(batches, BATCH_BYTES):
            sets = sets_of(own)
            yield _found([(a, None, 0.0, *differences((x, np.ones(len(x))), empty)) for a, x in zip(batch.column("x").to_pylist(), sets, strict=True)])

    rows = texts.join(left.select("x").distinct(), "x", "left_semi").select("x", "t").mapInArrow(run, FOUND)
    return rows.drop("b").join(left.select(F.col("x").alias("a"), F.col("bucket").alias("b")), "a").withColumn("turn", F.lit(0))


# --- the join ------------------------------------------------------------------------------------------------------------


def _hub_pairs(leads: DataFrame) -> DataFrame:
    """(a, b): sets (x, n, lead) with the hubs of their lists by least hashes, if they share LEAD_SHARED of these, or all that the smaller set has."""
    posts = leads.select("x", "n", F.explode("lead").alias("token"))
    sizes = posts.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    met = written(posts.join(sizes, "token"), "lead-lists")
    central = met.groupBy("x").agg(F.sum("m").alias("met"))
    met = written(met.join(central, "x").select("token", "x", "n", "met"), "lead-met")
    hubs = met.groupBy("token").agg(F.max(F.struct("met", "x", "n")).alias("hub"))
    both = met.join(hubs, "token").filter("x <> hub.x AND 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    shared = both.groupBy(F.col("x").alias("a"), F.col("hub.x").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.filter(F.col("shared") >= F.least(F.lit(LEAD_SHARED), "n")).select("a", "b")


def set_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id), a row for each row of docs: the lowest key that links reach, its own included.

    Words are separated by ASCII white space, A-Z in lower case. A text of fewer than five words is one shingle; a text without words,
    or null, has none, is linked with nothing and keeps its own key. Rows with equal sets are linked, repeated rows so too. Keys that
    are null count last: component_id is null only where no row of the component has a key. Shingles and sets are told apart by
    64-bit hashes. An empty table gives an empty table; other columns aren't read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    read = written(_sets(rows), "sets")
    ids = read.filter("n IS NOT NULL").select("k", "x", "n")
    ranks = spark.sparkContext.broadcast(_ranks(read.filter("slice IS NOT NULL").select("slice", "counts")))
    leads = written(read.filter("n > 0").groupBy("x").agg(F.first("n").alias("n"), F.first("lead").alias("lead")), "leads")

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        texts, folder = _contents(rows, pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), name)
        found = written(_compared(pairs, texts, THRESHOLD), f"{name}-links").select("a", "b")
        _released(spark, folder)
        return found

    links = compared(written(_hub_pairs(leads), "hub-pairs"), "hub")
    roots = written(components(links).select(F.col("v").alias("x"), "root"), "hub-roots")
    prefixes = written(_prefixes(rows.select("t"), ranks, roots), "prefixes")
    _released(spark)
    # hot components, whose sets are marked once in each list they are in, however many they are
    hot = roots.groupBy("root").agg(F.count("*").alias("m")).filter(F.col("m") >= max(HOT, leads.count() // HOT_PARTS)).select(F.col("root").alias("of"))
    hot = F.broadcast(written(hot, "hot-roots"))
    of_hot = F.coalesce("root", "x") == F.col("of")
    usual = prefixes.join(hot, of_hot, "left_anti").select("x", "n", "root", F.posexplode("p").alias("pos", "token"))
    crowd = prefixes.join(hot, of_hot).select("x", F.col("of").alias("root"), F.explode("p").alias("token"))
    marks = crowd.groupBy("token", "root").agg(F.first("x").alias("x"))
    postings = usual.select("token", "x", "root", _place(F.col("pos"), F.col("n"), False).alias("place")).union(marks.select("token", "x", "root", _place(F.lit(0), F.lit(1), True)))
    listed = written(_listed(postings), "index-lists")
    del postings, usual, marks
    _released(spark)
    pairs = written(_possible(listed.filter("token IS NULL"), prefixes, THRESHOLD), "list-pairs")
    found = [links, compared(pairs, "list")]
    long = listed.filter("token IS NOT NULL")
    if not long.isEmpty():
        crowded = crowd.join(long.filter("a IS NULL").select("token").distinct(), "token", "left_semi").select("token", "x")
        members = long.filter("a IS NOT NULL").select("token", F.col("a").alias("x")).union(crowded).join(roots, "x", "left").select(F.col("token").alias("bucket"), "x", F.coalesce("root", "x").alias("root"))
        members = written(members, "long-members")
        several = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
        members = written(members.join(written(several, "open-lists"), "bucket", "left_semi").select("bucket", "x"), "long-lists")
        texts, folder = _contents(rows, members.select("x").distinct(), "long")
        found += _by_hubs(members, prefixes, texts, roots)
        _released(spark, folder)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    ends = written(components(every).select(F.col("v").alias("x"), "root"), "set-roots")
    classed = written(ids.join(ends, "x", "left").select("k", "n", F.coalesce("root", "x").alias("root")), "set-ids")
    lowest = written(classed.filter("n > 0").groupBy("root").agg(F.min("k").alias("component_id")), "set-lowest")
    some = classed.filter("n > 0").join(lowest, "root").select("k", "n", "component_id")
    return some.union(classed.filter("n = 0").select("k", "n", "k")).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _contents(docs: DataFrame, wanted: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(x, t): a packed text of each wanted set x, and the folder it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "t", BATCH_BYTES):
            texts = texts_of(part.column("t"))
            yield pa.record_batch([pa.array([set_hash(h) for h in sets_of(texts)], pa.int64()), packed(texts)], names=["x", "t"])

    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, f"{name}-texts")
    # shuffled at every size, rather than with wanted sent to all tasks while it is small, so that plans stay alike
    docs.select("t").mapInArrow(run, "x long, t binary").join(wanted.hint("merge"), "x", "left_semi").dropDuplicates(["x"]).write.parquet(folder)
    _released(spark)
    return spark.read.schema("x long, t binary").parquet(folder), folder


def _released(spark: SparkSession, folder: str | None = None) -> None:
    """Lets go of what is done with: a folder of texts, and the shuffle files of plans that nothing refers to any more, which Spark's
    cleaner removes when the driver collects its garbage."""
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
