"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

A passage of MIN_WORDS words holds, among its first SPREAD word positions, one whose GRAM words hash lowest; both copies select it,
whatever stands around. Only these suffixes are retained. Suffixes whose first CORE words no other document has are dropped by a
count; the rest are sorted by what follows and what stands before, and each is compared with its neighbours of other documents and
extended right and left. A suffix farther off may share more on one side, unless all of the class have the same words before or
behind the core, or the class has two suffixes only: what neighbours leave open in other classes is looked through exactly, by the
hashes of the passages about each suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, mix64, small_batches, texts_of, windows, word_hashes, written

MIN_WORDS, GRAM, SPREAD = 50, 6, 20
#: Words behind a selected position that any passage about it holds, and words beyond that can matter on either side.
CORE = MIN_WORDS - SPREAD + 1
REACH = MIN_WORDS - CORE
BATCH_BYTES = 2 << 20
#: Whether a text has all words of a passage that begins {x} words before a core: before and after hold 0 beyond it.
_INSIDE = f"({{x}} = 0 OR substring(before, 4 * {{x}} - 3, 4) <> X'00000000') AND ({{x}} = {REACH} OR substring(after, 4 * ({REACH} - {{x}}) - 3, 4) <> X'00000000')"


def selected(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the lowest GRAM-word hash of any SPREAD neighbouring ones, the first of equals, with CORE words behind them in their text."""
    n = len(hashes) - GRAM + 1
    if n < SPREAD:
        return np.empty(0, np.int64)
    gram = windows(hashes, GRAM)
    inner = first[1:-1]
    for i in range(1, GRAM):  # a gram that runs into the next text never wins
        at = inner - i
        gram[at[(at >= 0) & (at < n)]] = np.iinfo(np.uint64).max
    view = np.lib.stride_tricks.sliding_window_view(gram, SPREAD)
    chosen = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    end = first[np.searchsorted(first, chosen, side="right")]
    return chosen[chosen + CORE <= end]


def _classes(docs: DataFrame) -> DataFrame:
    """(k, r, pos, c): the selected positions of each text and the hash of the CORE words there."""
    key = docs.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "t", BATCH_BYTES):
            hashes, first = word_hashes(texts_of(part.column("t")))
            at = selected(hashes, first)
            core = windows(hashes, CORE)[at] if len(at) else np.empty(0, np.uint64)
            owner = np.searchsorted(first, at, side="right") - 1
            take = pa.array(owner)
            yield pa.record_batch([part.column("k").take(take), part.column("r").take(take), pa.array(at - first[owner], pa.int32()), pa.array(core.astype(np.int64))], names=["k", "r", "pos", "c"])

    return docs.select("k", "r", "t").mapInArrow(run, T.StructType([T.StructField("k", key), T.StructField("r", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("c", T.LongType())]))


def _context(hashes: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """REACH words from at on, in direction step, as 32 bits each; 0 beyond the text, and never 0 inside."""
    place = at[:, None] + step * np.arange(REACH)
    inside = (place >= begin[:, None]) & (place < end[:, None])
    values = (hashes[np.clip(place, 0, len(hashes) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, values, 0).astype(">u4")


def _suffixes(docs: DataFrame) -> DataFrame:
    """(c, after, before, k, r, pos, source) for the listed positions of each text; after and before are the words around the core."""
    key = docs.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, "t", BATCH_BYTES):
            hashes, first = word_hashes(texts_of(part.column("t")))
            lists = part.column("at")
            owner = np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(lists)))
            flat = lists.flatten()
            pos = np.asarray(flat.field("pos"))
            if not len(pos):
                continue
            at, begin, end = first[owner] + pos, first[owner], first[owner + 1]
            raw = lambda x: pa.array([bytes(row) for row in x], pa.binary())
            take = pa.array(owner)
            yield pa.record_batch(
                [flat.field("c"), raw(_context(hashes, at + CORE, begin, end, 1)), raw(_context(hashes, at - 1, begin, end, -1)), part.column("k").take(take), part.column("r").take(take), flat.field("pos"), flat.field("source")],
                names=["c", "after", "before", "k", "r", "pos", "source"],
            )

    fields = [("c", T.LongType()), ("after", T.BinaryType()), ("before", T.BinaryType()), ("k", key), ("r", T.LongType()), ("pos", T.IntegerType()), ("source", key)]
    return docs.select("k", "r", "t", "at").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, REACH)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading words that both rows share."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), REACH, (~same).argmax(1))


def _extend(core: np.ndarray, doc: np.ndarray, after: np.ndarray, before: np.ndarray, to: np.ndarray, left: np.ndarray, right: np.ndarray, tails: np.ndarray) -> None:
    """Extends each row against the row to[i] (-1: none), and widens left and right where both make a whole passage. tails gets how
    many words behind the core are the same; no suffix of another document has more than the nearest ones in sorted order."""
    i = np.flatnonzero((to >= 0) & (core == core[to]) & (doc != doc[to]))
    if len(i):
        lead, tail = _common(before[i], before[to[i]]), _common(after[i], after[to[i]])
        tails[i] = np.maximum(tails[i], tail)
        whole = lead + tail >= REACH
        i, lead, tail = i[whole], lead[whole], tail[whole]
        left[i], right[i] = np.maximum(left[i], lead), np.maximum(right[i], tail)


def _documents(k: pa.Array, r: np.ndarray) -> np.ndarray:
    """A number for each document among the rows."""
    ids = pa.compute.dictionary_encode(k, null_encoding="encode").indices
    return mix64(np.asarray(ids).astype(np.uint64)) ^ r.astype(np.uint64)


def _neighbours(suffixes: DataFrame) -> DataFrame:
    """The sorted suffixes with left and right: how far a passage that a neighbour shares reaches beyond the core, or -1.

    A range of the sorted suffixes is one task's; side is 1 for rows of its first document, 2 for rows of its last (3: both),
    whose neighbour on that side stands in another task, part. mixed is 0 where neighbours tell all of a class, 1 where others may
    share more, and 2 for classes that can go on in another task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        core = np.asarray(table.column("c"))
        doc = _documents(column("k"), np.asarray(table.column("r")))
        n = len(core)
        fresh = np.ones(n, bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (core[1:] != core[:-1])
        run_of, heads = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        above, below = heads[run_of] - 1, np.append(heads[1:], -1)[run_of]
        left, right, tails = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.int32)
        after, before = _words(column("after")), _words(column("before"))
        for to in (above, below):
            _extend(core, doc, after, before, to, left, right, tails)
        side = (run_of == 0) * 1 + (run_of == len(heads) - 1) * 2
        part = TaskContext.get().partitionId()
        first = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
        class_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
        uniform = [np.logical_and.reduceat((words == words[first][class_of]).all(1), first) for words in (after, before)]
        mixed = np.where(uniform[0] | uniform[1] | (np.diff(np.append(first, n)) == 2), 0, 1)
        mixed[[0, -1]] = 2
        mixed = mixed[class_of]
        out = table.append_column("left", pa.array(left)).append_column("right", pa.array(right)).append_column("tail", pa.array(tails)).append_column("mixed", pa.array(mixed.astype(np.int32))).append_column("side", pa.array(side.astype(np.int32))).append_column("part", pa.array(np.full(n, part, np.int32)))
        yield from out.to_batches(max_chunksize=5000)

    fields = [*suffixes.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ("left", "right", "tail", "mixed", "side", "part"))]
    order = ["c", "after", "before", "k", "r", "pos"]
    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suffixes.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, T.StructType(fields))


def _across(edges: DataFrame) -> DataFrame:
    """The rows at the ends of ranges, compared with the nearest row of the range before or behind.

    Two rows of each range, the first and the last, go to the driver: as many as there are tasks. Where that row is of the same
    document, another's may lie behind it: then mixed gets 4, and tail leaves all open.
    """
    ends = edges.groupBy("part").agg(*(f(F.struct("c", "after", "before", "k", "r", "pos")).alias(a) for f, a in ((F.min, "first"), (F.max, "last")))).orderBy("part").collect()
    place = {x["part"]: i for i, x in enumerate(ends)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            left, right, tails, mixed = (np.asarray(batch.column(c)).copy() for c in ("left", "right", "tail", "mixed"))
            core, r = np.asarray(batch.column("c")), np.asarray(batch.column("r"))
            after, before = _words(batch.column("after")), _words(batch.column("before"))
            part, side, keys = np.asarray(batch.column("part")), np.asarray(batch.column("side")), batch.column("k").to_pylist()
            for bit, step, end in ((1, -1, "last"), (2, 1, "first")):
                for p in np.unique(part[side & bit > 0]):
                    to = place[int(p)] + step
                    if not 0 <= to < len(ends):
                        continue
                    e = ends[to][end]
                    other = np.array([keys[i] != e["k"] or r[i] != e["r"] for i in range(n)])
                    met = (part == p) & (side & bit > 0) & (core == e["c"])
                    tails[met & ~other], mixed[met & ~other] = REACH, mixed[met & ~other] | 4
                    i = np.flatnonzero(met & other)
                    if len(i):
                        lead = _common(before[i], np.frombuffer(bytes(e["before"]), ">u4")[None, :])
                        tail = _common(after[i], np.frombuffer(bytes(e["after"]), ">u4")[None, :])
                        tails[i] = np.maximum(tails[i], tail)
                        whole = lead + tail >= REACH
                        left[i[whole]] = np.maximum(left[i[whole]], lead[whole])
                        right[i[whole]] = np.maximum(right[i[whole]], tail[whole])
            out = batch.drop_columns(["left", "right", "tail", "mixed"])
            yield pa.record_batch([*out.columns, *(pa.array(x, pa.int32()) for x in (left, right, tails, mixed))], names=[*out.schema.names, "left", "right", "tail", "mixed"])

    columns = [f for f in edges.schema.fields if f.name not in ("left", "right", "tail", "mixed")]
    return edges.mapInArrow(run, T.StructType([*columns, *(T.StructField(c, T.IntegerType()) for c in ("left", "right", "tail", "mixed"))])).select(*edges.columns)


def _open_leads(checked: DataFrame) -> DataFrame:
    """(c, leads): for each class the leads of passages that neighbours leave open, from one sum of bits, one bit for each lead.

    A class that can go on in another task is open if it has more than two suffixes that differ before and behind the core. Bits are
    combined where the rows are, so a task sends one row for each class, however large the class is.
    """
    bits = F.expr(f"aggregate(filter(sequence({REACH} - tail, {REACH}), x -> (x < {REACH} - right OR x > left) AND {_INSIDE.format(x='x')}), 0, (m, x) -> m | shiftleft(1, x))")
    edge = F.col("mixed").bitwiseAND(2) != 0
    rows = checked.filter("mixed <> 0").select("c", F.when(F.expr("mixed & 5 <> 0"), bits).otherwise(0).alias("sure"), F.when(F.expr("mixed = 2"), bits).otherwise(0).alias("perhaps"), edge.cast("int").alias("edge"), *(F.when(edge, F.xxhash64(w)).alias(w) for w in ("before", "after")))
    ends = [f(w).alias(f"{a}_{w}") for w in ("before", "after") for a, f in (("low", F.min), ("high", F.max))]
    classes = rows.groupBy("c").agg(F.bit_or("sure").alias("sure"), F.bit_or("perhaps").alias("perhaps"), F.sum("edge").alias("n"), *ends)
    apart = F.expr("n > 2 AND low_before <> high_before AND low_after <> high_after")
    leads = classes.select("c", F.col("sure").bitwiseOR(F.when(apart, F.col("perhaps")).otherwise(0)).alias("leads")).filter("leads <> 0")
    return leads.select("c", F.expr(f"filter(sequence(0, {REACH}), x -> leads & shiftleft(1, x) <> 0)").alias("leads"))


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of MIN_WORDS or more words that two or more documents share: (key, begin, end, n_words, source).

    A row for each passage of each document that has one, the first document included; begin and end count words, end excluded,
    and overlapping passages are one. source is the lowest key of a document that shares part of it, so all but the rows with
    source = key can go. Words are runs of anything but ASCII white space, compared byte by byte through 64-bit hashes. Whole
    texts are read; a null or empty text, or one of fewer words, has no passage. Rows with the same key and text are one document;
    a null key is never a source, which is null if all documents have it. An empty table gives an empty table; other columns aren't read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r"), F.col(text).alias("t"))
    found = written(_classes(rows), "suffix-classes")
    who = F.xxhash64("k", "r")
    several = lambda df, by: df.groupBy(by).agg(F.min("k").alias("source"), F.min(who).alias("low"), F.max(who).alias("high")).filter("low <> high")
    # tables of their own, so that the joins can split the rows of a hot class
    shared = written(several(found, "c").select("c", "source"), "suffix-shared")
    at = found.join(shared, "c").groupBy("k", "r").agg(F.collect_set(F.struct("pos", "c", "source")).alias("at"))
    same = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["r"] == b["r"])
    # one row of each document, though rows repeat
    texts = rows.join(at, same(rows, at)).select(rows["k"], rows["r"], "t", "at")
    compared = written(_neighbours(_suffixes(texts)), "suffix-neighbours")
    inner = compared.filter("side = 0").select(*compared.columns)
    checked = inner.unionByName(_across(compared.filter("side > 0")))
    done = checked.filter("left >= 0").select("k", "r", "source", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + CORE + F.col("right")).alias("end"))

    # passages of MIN_WORDS that neighbours leave open, by how many words they begin before the core; those that reach farther behind
    # it than any neighbour agrees aren't shared
    lead = F.col("lead")
    inside = F.expr(_INSIDE.format(x="lead"))
    asked = written(_open_leads(checked), "suffix-open")
    rest = checked.join(asked, "c")
    head, tail = F.expr("substring(before, 1, 4 * lead)"), F.expr(f"substring(after, 1, 4 * ({REACH} - lead))")
    about = rest.select("c", "k", "r", "pos", "source", "before", "after", F.explode(F.expr(f"filter(leads, x -> x >= {REACH} - tail)")).alias("lead"))
    passages = written(about.filter(inside).select(F.xxhash64("c", lead, head, tail).alias("h"), "k", "r", "source", (F.col("pos") - lead).alias("begin")), "passages")
    both = written(several(passages, "h").select("h"), "passages-shared")
    exact = passages.join(both, "h", "left_semi").select("k", "r", "source", "begin", (F.col("begin") + MIN_WORDS).alias("end"))

    spans = done.unionByName(exact).groupBy("k", "r").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "source"))).alias("spans"))
    item = "struct<begin:int,end:int,source:" + docs.schema[key].dataType.simpleString() + ">"
    merged = F.aggregate(
        "spans",
        F.array().cast(f"array<{item}>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["begin"] <= F.element_at(acc, -1)["end"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["begin"].alias("begin"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.least(F.element_at(acc, -1)["source"], s["source"]).alias("source")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    out = spans.select("k", F.explode(merged).alias("s"))
    return out.select(F.col("k").alias(key), F.col("s.begin").cast("bigint").alias("begin"), F.col("s.end").cast("bigint").alias("end"), (F.col("s.end") - F.col("s.begin")).cast("bigint").alias("n_words"), F.col("s.source").alias("source"))
