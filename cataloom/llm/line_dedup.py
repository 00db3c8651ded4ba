"""Line deduplication with DataFrame functions only: per-document keep bitmaps instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: White space that is stripped at both ends of a line's key.
_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; plain ASCII takes the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_postings(docs: DataFrame, *, min_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, k, r, pos, first): the hash of the key of each line, its document, the hash of the text, its place, and whether it is the
    line's first place in the document.

    Postings are range-partitioned by hash and document and sorted by hash, document and place; first occurrences are streamed from
    that order, without another shuffle. A hot line spreads over partitions, since the ranges go on within its hash. Lines whose key
    has fewer than min_chars code points have no posting."""
    lines = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n", -1)
    strip = F.lit(_STRIP)
    hashes = F.transform(lines, lambda x: F.when(F.length(F.btrim(x, strip)) >= min_chars, F.xxhash64(F.btrim(x, strip))))
    rows = docs.select(F.col(key).alias("k"), _row_hash(text).alias("r"), F.posexplode(hashes).alias("pos", "h")).filter("h IS NOT NULL")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("h", "k", "r", "pos").repartitionByRange(n, "h", "k").sortWithinPartitions("h", "k", "pos")
    return ranges.withColumn("first", F.row_number().over(Window.partitionBy("h", "k").orderBy("pos")) == 1)


def line_bitmaps(docs: DataFrame, *, min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Which lines of each document stay, as bitmaps: (k, r, keep, n_dropped), with a row for each text that loses a line.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys in min_docs or more documents lose
    all their lines or, with keep_first, all but the first by document and place. keep lists (word, bits) for those runs of 64
    lines that lose any, in order; a bit that is set keeps its line, and runs that are not listed stay whole. Documents are told
    apart by key: rows that repeat one count once. A null key is one document. r is the hash of the text, for rows with the same
    key and other texts. Empty tables give an empty table; other columns are not read.
    """
    postings = written(line_postings(docs, min_chars=min_chars, key=key, text=text), "line-postings")
    # a line's documents lie in one range or in neighbouring ones: each range gives one row of a line, and these are combined
    found = postings.filter("first").groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("k", "pos")).alias("first")).filter(F.col("n") >= min_docs)
    # a table of its own, so that the join can split a hot line's postings, or send the found lines to them if they are few
    hits = postings.drop("first").join(written(found.select("h", "first"), "line-found"), "h")
    if keep_first:
        hits = hits.filter(~(F.col("k").eqNullSafe(F.col("first.k")) & (F.col("pos") == F.col("first.pos"))))
    words = hits.groupBy("k", "r", F.shiftright("pos", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, pos & 63))").alias("dropped"))
    per_text = words.groupBy("k", "r").agg(F.sort_array(F.collect_list(F.struct("word", F.expr("~dropped").alias("bits")))).alias("keep"), F.sum(F.bit_count("dropped")).cast("bigint").alias("n_dropped"))
    return per_text


def kept_lines(docs: DataFrame, bitmaps: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Applies the bitmaps: (key, n_lines, n_dropped, kept), a row for each row of docs.

    n_lines counts the lines before dropping (one for a null or empty text); kept is the other lines, joined by \\n.
    """
    # from the listed runs to one number for each run up to the last, so that a line finds its bit in one step
    dense = F.aggregate("keep", F.array().cast("array<bigint>"), lambda acc, w: F.concat(acc, F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - F.size(acc)), F.array(w["bits"])))
    maps = bitmaps.select(F.col("k").alias("bk"), F.col("r").alias("br"), dense.alias("dense"), F.col("n_dropped").alias("dropped"))
    rows = docs.select(F.col(key).alias("k"), _row_hash(text).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    joined = rows.join(maps, F.col("k").eqNullSafe(F.col("bk")) & (F.col("r") == F.col("br")), "left")
    lines = F.split("t", "\n", -1)
    bit = lambda i: F.call_function("shiftright", F.coalesce(F.get("dense", F.shiftright(i, 6)), F.lit(-1).cast("bigint")), i.bitwiseAND(63)).bitwiseAND(1)
    kept = F.when(F.col("dense").isNull(), F.col("t")).otherwise(F.array_join(F.filter(lines, lambda _, i: bit(i) == 1), "\n"))
    return joined.select(F.col("k").alias(key), F.size(lines).cast("bigint").alias("n_lines"), F.coalesce("dropped", F.lit(0)).cast("bigint").alias("n_dropped"), kept.alias("kept"))
