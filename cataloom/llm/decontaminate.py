"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

The index holds, for the rarest terms of the test windows, each place in the training texts where they stand, with the words
around. A window is looked up by its two rarest terms: their posting lists are adjusted by the terms' offsets and intersected,
and the words around a place that is left are compared with the item's, which gives exact phrases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .line_dedup import ascii_lower

#: What stands between words, once A-Z is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Tables of the test set of up to so many bytes, arrays and all, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _sized(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if its rows, as text with some 40 bytes for each value, are small."""
    size = df.select(F.octet_length(F.struct("*").cast("string")).alias("bytes")).agg(F.sum(F.col("bytes") + 40 * len(df.columns))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class Index:
    """anchors: (item, p, second, p2, n, before, after) for each term by which windows are looked up; postings: (term, k, r, pos, before, after)."""

    anchors: DataFrame
    postings: DataFrame
    window: int


def build_index(docs: DataFrame, items: DataFrame, *, window: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> Index:
    """Counts the test terms over all docs, chooses the two rarest terms of each test window, and stores the postings of these.

    An item of fewer than window words, but not none, is one window; a null text has no words. Repeated items count once.
    Ties between equally rare terms go to the earlier place. r, the hash of a document's text, tells rows with one key apart.
    """
    tests = written(items.select(F.col(item_key).alias("item"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0).distinct(), "test-items")
    vocabulary = written(tests.select(F.explode("words").alias("term")).distinct(), "test-terms")
    counted = docs.select(F.explode(words_of(F.col(text))).alias("term")).join(_sized(vocabulary), "term").groupBy("term").agg(F.count("*").alias("freq"))
    frequency = written(counted, "term-counts")

    size = F.least(F.lit(window), F.size("words"))
    starts = tests.select("item", "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
    placed = starts.select("item", "words", "start", F.posexplode(F.slice("words", F.col("start") + 1, size)).alias("o", "term"))
    # a window with a term that no document has can't occur: it has no frequency there
    rated = placed.join(frequency, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    best = F.array_sort(F.collect_list(F.struct("freq", (F.col("start") + F.col("o")).alias("p"), "term")))
    rarest = rated.groupBy("item", "words", "start").agg(best.alias("terms")).filter(F.col("terms")[0]["freq"] > 0)
    first, second = F.col("terms")[0], F.coalesce(F.get("terms", F.lit(1)), F.col("terms")[0])
    n = F.least(F.lit(window), F.size("words"))
    p = F.col("p")
    anchors = written(
        rarest.select("item", "words", first["term"].alias("term"), first["p"].alias("p"), second["term"].alias("term2"), second["p"].alias("p2"))
        .distinct()
        .select("item", "term", "p", "term2", "p2", n.alias("n"), F.reverse(F.slice("words", F.greatest(p - window + 2, F.lit(1)), F.least(p, F.lit(window - 1)))).alias("item_before"), F.slice("words", p + 2, window - 1).alias("item_after")),
        "anchors",
    )
    terms = written(anchors.select("term", F.lit(True).alias("leads")).union(anchors.select("term2", F.lit(False))).groupBy("term").agg(F.max("leads").alias("leads")), "index-terms")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r"), words_of(F.col(text)).alias("words"))
    places = rows.select("k", "r", "words", F.posexplode("words").alias("pos", "term")).join(_sized(terms), "term")
    pos = F.col("pos")
    around = lambda c: F.when(F.col("leads"), c)
    postings = places.select(
        "term", "k", "r", "pos",
        around(F.reverse(F.slice("words", F.greatest(pos - window + 2, F.lit(1)), F.least(pos, F.lit(window - 1))))).alias("before"),
        around(F.slice("words", pos + 2, window - 1)).alias("after"),
    )
    return Index(anchors, written(postings, "postings"), window)


def _equal(a: str, b: str) -> Column:
    """How many leading words of both arrays are the same."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def phrase_matches(index: Index) -> DataFrame:
    """(k, r, item, begin, end): runs of document words, end included, that occur as such in the item and hold a whole window."""
    lead, other = index.anchors, index.anchors.select("item", F.col("term2").alias("term"), "p2").distinct()
    at = index.postings.join(_sized(lead), "term").withColumn("delta", F.col("pos") - F.col("p"))
    second = index.postings.select("term", "k", "r", "pos").join(_sized(other), "term").select("k", "r", "item", "p2", (F.col("pos") - F.col("p2")).alias("delta"))
    key = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["r"] == b["r"]) & (a["item"].eqNullSafe(b["item"])) & (a["delta"] == b["delta"]) & (a["p2"] == b["p2"])
    both = at.join(second, key(at, second), "left_semi")
    runs = both.select("k", "r", "item", "pos", "n", _equal("before", "item_before").alias("left"), _equal("after", "item_after").alias("right"))
    return runs.filter("left + right + 1 >= n").select("k", "r", "item", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right")).alias("end"))


def proximity_matches(index: Index, slop: int = 3) -> DataFrame:
    """(k, item, place, gap): places where a window's two rarest terms stand as in the item but for a shift of at most slop words.

    gap is that shift; exact phrases have 0. Places are dealt by runs of slop + 1 offsets, so that only neighbouring runs meet.
    """
    step = slop + 1
    at = index.postings.select("term", "k", "r", "pos").join(_sized(index.anchors.select("item", "term", "p", "p2", "term2")), "term").withColumn("delta", F.col("pos") - F.col("p"))
    at = at.select("k", "r", "item", "p2", "term2", "delta", "pos", F.explode(F.array(*(F.floor(F.col("delta") / step) + d for d in (-1, 0, 1)))).alias("run"))
    other = index.anchors.select("item", "p2", F.col("term2").alias("term")).distinct()
    near = index.postings.select("term", "k", "r", "pos").join(_sized(other), "term").select(F.col("k").alias("k2"), F.col("r").alias("r2"), F.col("item").alias("item2"), F.col("p2").alias("q2"), (F.col("pos") - F.col("p2")).alias("delta2"))
    near = near.withColumn("run2", F.floor(F.col("delta2") / step))
    met = at.join(near, F.col("k").eqNullSafe(F.col("k2")) & (F.col("r") == F.col("r2")) & F.col("item").eqNullSafe(F.col("item2")) & (F.col("p2") == F.col("q2")) & (F.col("run") == F.col("run2")))
    gap = F.abs(F.col("delta") - F.col("delta2"))
    return met.filter(gap <= slop).groupBy("k", "r", "item", F.col("pos").alias("place")).agg(F.min(gap).alias("gap"))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 13, share: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """What of each document occurs in test items: (key, r, n_words, n_hit, n_items, item_ids, contaminated), a row for each row of docs.

    n_hit counts the words inside any occurrence of a window; n_items and item_ids tell the items with occurring windows;
    contaminated is n_hit > 0 and share * n_hit >= n_words. A null or empty text has no words; rows that repeat give rows that
    repeat; a null key is a key like others. Without items, or with an empty table of docs, nothing is hit. Other columns of
    both tables are not read.
    """
    matches = written(phrase_matches(build_index(docs, items, window=window, key=key, text=text, item_key=item_key, item_text=item_text)), "matches")
    hit = matches.select("k", "r", F.explode(F.sequence("begin", "end")).alias("pos")).distinct().groupBy("k", "r").agg(F.count("*").alias("n_hit"))
    found = matches.select("k", "r", "item").distinct().groupBy("k", "r").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("item_ids"))
    same = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["r"] == b["r"])
    hits = hit.join(found, same(hit, found)).select(hit["k"], hit["r"], "n_hit", "n_items", "item_ids")
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("r"), F.size(words_of(F.col(text))).cast("bigint").alias("n_words"))
    out = rows.join(hits, same(rows, hits), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select(rows["k"].alias(key), rows["r"], "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
