"""A stored inverted index for BM25: block-compressed postings, clustered by term, with the greatest impact of each block.

Documents are dealt over segments by a hash of their ids, about SEGMENT_DOCS in each; a block holds the postings of one term in one
segment, so a frequent term has many bounded blocks. Blocks lie in folders by a hash of their term and are sorted by term within files,
so a search reads its terms' folders (partition pruning) and row groups (statistics) and nothing of the rest. From the light columns of
its blocks it bounds each segment's best score; segments below what k documents are known to reach are skipped, and only the other
blocks are unpacked. These are dealt, packed, by segment, and a segment's documents are scored where its blocks meet, so that pairs of a
query and a document are never shuffled but those of shortlists. The result is that of retrieve.bm25.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stem import stemmed
from ..functions.text import terms
from ..session import small_batches
from ..sources.storage import released
from .retrieve import BROADCAST_PAIRS, CELLS, Best, Request, top

#: Documents of a segment, about, and so the most postings of a block.
SEGMENT_DOCS = 4096
#: Folders of blocks.
BUCKETS = 64
#: Groups of segments that are dealt to tasks, at least: a folder has a file or two for each.
LEAST_GROUPS = 8
#: A term's greatest impacts that are kept: searches for up to so many documents can skip segments.
BEST = 100
#: Distinct terms of a request that are written into the plan; more are joined.
LITERAL_TERMS = 1000
#: The tables of an index; kind is the type of ids.
BLOCKS = "term string, seg int, n int, top double, ids array<{kind}>, tfs array<int>, dls array<int>, bucket int"
TERMS = "term string, df long, top double, cf long, best array<double>, bucket int"
STATS = "n_docs double, avgdl double, k1 double, b double, buckets int, segments int, stems boolean, stopwords array<string>, kind string"
#: Bytes of a row group, the unit that statistics on terms can skip.
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Analyser:
    """How texts become terms: words in lower case, without stopwords, as stems if asked for. Stems are made once for each distinct
    word, not for each occurrence."""

    stems: bool = False
    stopwords: Sequence[str] = field(default=())

    def words(self, text: Column) -> Column:
        words = terms(text)
        if self.stopwords:
            stop = F.array(*(F.lit(w) for w in self.stopwords))
            words = F.filter(words, lambda w: ~F.array_contains(stop, w))
        return words

    def named(self, rows: DataFrame) -> DataFrame:
        """rows with their words in column term replaced by stems."""
        if not self.stems:
            return rows
        vocabulary = rows.select("term").distinct().select("term", stemmed(F.array("term"))[0].alias("stem"))
        return rows.join(vocabulary, "term").drop("term").withColumnRenamed("stem", "term")


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _segment(id: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(segments)).cast("int")


def _impact(tf: Column, dl: Column, k1: float | Column, b: float | Column, avgdl: Column) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _counted(words: Column) -> Column:
    """The distinct words of one text as (term, tf): where each begins in the sorted words, up to where the next begins."""
    def runs(s: Column) -> Column:
        place = F.sequence(F.lit(1), F.size(s))
        starts = F.filter(place, lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        ends = F.concat(F.slice(starts, 2, F.size(s)), F.array(F.size(s) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(s, a).alias("term"), (b - a).alias("tf")))

    none = F.array().cast("array<struct<term:string,tf:int>>")
    # bound once, so that the words are sorted once
    return F.when(F.size(words) > 0, F.transform(F.array(F.array_sort(words)), runs)[0]).otherwise(none)


def build(texts: DataFrame, path: str, *, analyser: Analyser = Analyser(), k1: float = 1.2, b: float = 0.75, buckets: int = BUCKETS, segment_docs: int = SEGMENT_DOCS) -> SparseIndex:
    """Writes the index of texts (id, text) below path: blocks, terms and, last, stats, without which there is no index.

    Ids are of any type that has an order; each is one document. A null or empty text is a document without terms. k1 and b are fixed
    in the bounds of blocks. One shuffle makes the blocks; a term's postings meet in one task only for one of LEAST_GROUPS or more groups
    of segments.
    """
    spark = texts.sparkSession
    docs = texts.select("id", analyser.words(F.col("text")).alias("words"))
    sums = docs.agg(F.count("*").cast("double").alias("n_docs"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("avgdl"))
    stats = sums.withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b)), "buckets": F.lit(buckets), "segments": F.greatest(F.lit(1), F.ceil(F.col("n_docs") / segment_docs)).cast("int"), "stems": F.lit(analyser.stems), "stopwords": F.array(*(F.lit(w) for w in analyser.stopwords)).cast("array<string>"), "kind": F.lit(texts.schema["id"].dataType.simpleString())}).first()
    rows = docs.select("id", F.size("words").alias("dl"), F.inline(_counted(F.col("words"))))
    # words are counted where they are read; dealt once by folder and group of segments, and both groupings and the files keep that
    groups = min(stats["segments"], max(LEAST_GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    seg = _segment(F.col("id"), stats["segments"])
    places = {"bucket": _bucket(F.col("term"), buckets), "part": F.pmod(seg, F.lit(groups))}
    # what follows from id and term isn't shuffled
    rows = analyser.named(rows).repartition(*places.values()).withColumns(places | {"seg": seg})
    tf = rows.groupBy("bucket", "part", "term", "seg", "id", "dl").agg(F.sum("tf").cast("int").alias("tf"))
    blocks = tf.groupBy("bucket", "part", "term", "seg").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "dl"))).alias("p"))
    bound = F.array_max(F.transform("p", lambda x: _impact(x["tf"], x["dl"], k1, b, F.lit(stats["avgdl"] or 1.0))))
    packed = blocks.select("term", "seg", F.size("p").alias("n"), bound.alias("top"), *(F.col(f"p.{c}").alias(f"{c}s") for c in ("id", "tf", "dl")), "bucket")
    packed.sortWithinPartitions("bucket", "term", "seg").write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/blocks")
    released(spark)
    written = spark.read.schema(BLOCKS.format(kind=stats["kind"])).parquet(f"{path}/blocks")
    # a term's best impacts all lie in its blocks with the greatest bounds; of a block its best alone are shuffled
    first = Window.partitionBy("bucket", "term").orderBy(F.col("top").desc(), "seg")
    impact = lambda x: _impact(x["tfs"], x["dls"], k1, b, F.lit(stats["avgdl"] or 1.0))
    ordered = F.sort_array(F.transform(F.arrays_zip("tfs", "dls"), lambda x: F.struct(impact(x).alias("i"), x["tfs"].alias("tfs"), x["dls"].alias("dls"))), asc=False)
    heads = written.select("bucket", "term", "seg", "top", F.when(F.col("n") > BEST, F.slice(ordered, 1, BEST)).alias("h"), "tfs", "dls")
    heads = heads.select("bucket", "term", "seg", "top", *(F.coalesce(F.col(f"h.{c}"), c).alias(c) for c in ("tfs", "dls")))
    impacts = F.transform(F.arrays_zip("tfs", "dls"), impact)
    ranked = heads.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= BEST).select("bucket", "term", impacts.alias("some"))
    best = ranked.groupBy("bucket", "term").agg(F.slice(F.sort_array(F.flatten(F.collect_list("some")), asc=False), 1, BEST).alias("best"))
    counts = written.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.max("top").alias("top"), F.sum(F.aggregate("tfs", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("cf"))
    named = counts.join(best, ["bucket", "term"])
    named.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    released(spark)
    spark.createDataFrame([stats], STATS).write.mode("overwrite").parquet(f"{path}/stats")
    return SparseIndex(spark, path)


@dataclass(frozen=True)
class SparseIndex:
    """An index that build has written."""

    spark: SparkSession
    path: str

    def _stats(self):
        return self.spark.read.schema(STATS).parquet(f"{self.path}/stats").first()

    @property
    def blocks(self) -> DataFrame:
        """(term, seg, n, top, ids, tfs, dls, bucket)."""
        return self.spark.read.schema(BLOCKS.format(kind=self._stats()["kind"])).parquet(f"{self.path}/blocks")

    @property
    def terms(self) -> DataFrame:
        """(term, df, top, cf, best, bucket)."""
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    def _asked(self, queries: DataFrame, stats) -> tuple[DataFrame, list[str] | None]:
        """(query_id, term), and the distinct terms if they are few."""
        analyser = Analyser(stats["stems"], stats["stopwords"])
        words = queries.select("query_id", F.explode(F.array_distinct(analyser.words(F.col("text")))).alias("term"))
        asked = analyser.named(words).distinct()
        few = [r["term"] for r in asked.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        return asked, few if len(few) <= LITERAL_TERMS else None

    def _read(self, rows: DataFrame, few: list[str] | None, asked: DataFrame, buckets: int) -> DataFrame:
        """Rows of the request's terms only: by folder and term in the scan, or by a join that prunes folders when it runs."""
        if few is None:
            wanted = asked.select("term").distinct().withColumn("bucket", _bucket(F.col("term"), buckets))
            return rows.join(wanted, ["bucket", "term"], "left_semi")
        folders = self.spark.createDataFrame([(t,) for t in few], "term string").select(_bucket(F.col("term"), buckets).alias("bucket")).distinct().collect()
        return rows.filter(F.col("bucket").isin([r["bucket"] for r in folders]) & F.col("term").isin(few))

    def _request(self, queries: DataFrame, k: int | None, prune: bool, idf: bool, stats) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The weights (query_id, term, weight) of a request, what its k best are known to reach (query_id, least), and its blocks."""
        asked, few = self._asked(queries, stats)
        df = F.col("df")
        weight = F.log(1 + (F.lit(stats["n_docs"]) - df + 0.5) / (df + 0.5)) if idf else F.lit(1.0)
        known = self._read(self.terms, few, asked, stats["buckets"]).join(asked, "term").withColumn("weight", weight)
        reached = F.when((df >= k) & (F.size("best") >= k), F.col("weight") * F.get("best", F.lit(k - 1))) if prune and k and k <= BEST else F.lit(None).cast("double")
        least = known.groupBy("query_id").agg(F.coalesce(F.max(reached), F.lit(0.0)).alias("least"))
        return known.select("query_id", "term", "weight"), least, self._read(self.blocks, few, asked, stats["buckets"])

    def _bounds(self, weights: DataFrame, least: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Segments (query_id, seg, bound), and those, with least, that can hold one of the k best: bound is what a document there has at
        most, least what k documents are known to reach."""
        bounds = blocks.select("term", "seg", "top").join(weights, "term").groupBy("query_id", "seg").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))
        # scores are compared in six digits
        return bounds, bounds.join(least, "query_id").filter(F.col("bound") >= F.col("least") - 2e-6)

    def segments(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """All segments (query_id, seg, bound) in which a request's terms are, and those that a search for k documents reads."""
        return self._bounds(*self._request(queries, k, True, True, self._stats()))

    def search(self, queries: DataFrame, k: int | None = None, *, allowed: DataFrame | None = None, idf: bool = True) -> DataFrame:
        """(query_id, id, score) for queries (query_id, text): documents that share a term; with k, those that can be among the k best
        of a query. allowed (id) restricts what is found, not the statistics; nothing is skipped then, since the best may be excluded, and
        all that is allowed is found, whatever k.
        """
        return self._found(queries, k, allowed, idf, allowed is None)

    def best(self, queries: DataFrame, k: int, *, allowed: DataFrame | None = None, idf: bool = True) -> DataFrame:
        """The k best of search with their rank from 1 on; ties go to the lower id. A task gives no more than what can be among them."""
        return top(self._found(queries, k, allowed, idf, True), k)

    def _found(self, queries: DataFrame, k: int | None, allowed: DataFrame | None, idf: bool, cut: bool) -> DataFrame:
        """search, with cut for the k best in each task. Blocks are shuffled by segment, and each segment's documents are scored against
        the request, which is broadcast. Requests of more than BROADCAST_PAIRS (query, term) pairs are joined by term."""
        stats = self._stats()
        weights, least, blocks = self._request(queries, k, allowed is None, idf, stats)
        kept = self._bounds(weights, least, blocks)[1].select("query_id", "seg") if allowed is None and k and k <= BEST else None
        # an index that doesn't tell the number of its segments is an older one
        if stats["segments"] and weights.count() <= BROADCAST_PAIRS:
            return self._by_segment(weights, blocks, kept, k if cut else None, allowed, stats)
        rows = blocks.join(weights, "term")
        if kept is not None:
            rows = rows.join(kept, ["query_id", "seg"])
        rows = rows.select("query_id", "weight", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        part = F.col("weight") * _impact(F.col("p.tfs"), F.col("p.dls"), stats["k1"], stats["b"], F.lit(stats["avgdl"] or 1.0))
        rows = rows.select("query_id", F.col("p.ids").alias("id"), part.alias("part"))
        if allowed is not None:
            rows = rows.join(allowed.select("id").distinct(), "id", "left_semi")
        return rows.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))

    def _by_segment(self, weights: DataFrame, blocks: DataFrame, kept: DataFrame | None, k: int | None, allowed: DataFrame | None, stats) -> DataFrame:
        """_found for a request that is broadcast. A segment's rows come together: the queries that read it, the ids that are allowed, and
        then its blocks by term."""
        small_batches(self.spark)
        kind, query_kind = stats["kind"], weights.schema["query_id"].dataType.simpleString()
        request = self.spark.sparkContext.broadcast(Request.of(weights))
        if kept is not None:
            kept = kept.groupBy("seg").agg(F.collect_list("query_id").alias("asked"))
            # broadcast, and so not shuffled by segment before the union: Spark 4.1 takes a union of sides that are for dealt as well
            blocks = blocks.join(F.broadcast(kept.select("seg")), "seg", "left_semi")
        rows = blocks.select("seg", F.lit(2).alias("what"), "term", "ids", "tfs", "dls", F.lit(None).cast(f"array<{query_kind}>").alias("asked"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("ids", f"array<{kind}>"), ("tfs", "array<int>"), ("dls", "array<int>"))]
        if kept is not None:
            rows = rows.union(kept.select("seg", F.lit(0), *none, "asked"))
        if allowed is not None:
            ids = allowed.select(F.col("id").cast(kind)).filter("id IS NOT NULL")
            rows = rows.union(ids.select(_segment(F.col("id"), stats["segments"]), F.lit(1), none[0], F.array("id"), *none[2:], F.lit(None).cast(f"array<{query_kind}>")))
        restricted, some = allowed is not None, kept is not None
        k1, b, avgdl = stats["k1"], stats["b"], stats["avgdl"] or 1.0

        def scored(parts: list[pa.RecordBatch], best: Best) -> Iterator[pa.RecordBatch]:
            r = best.request
            table = pa.Table.from_batches(parts)
            what = table.column("what").to_numpy()
            first, last = (int(np.searchsorted(what, x)) for x in (1, 2))
            lists = {c: table.column(c)[last:].combine_chunks() for c in ("ids", "tfs", "dls")}
            if not len(lists["ids"]):
                return
            flat = {c: x.flatten() for c, x in lists.items()}
            term = np.repeat(r.term(table.column("term")[last:].combine_chunks()), np.asarray(pa.compute.list_value_length(lists["ids"])))
            tf, dl = (flat[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tfs", "dls"))
            coded = flat["ids"].dictionary_encode("encode")
            ids, doc = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            good = term >= 0
            if restricted:
                good &= pa.compute.is_in(ids, table.column("ids")[first:last].combine_chunks().flatten()).to_numpy(zero_copy_only=False)[doc]
            queries = None
            if some:
                queries = np.zeros(len(r.asked), bool)
                queries[pa.compute.index_in(table.column("asked")[:first].combine_chunks().flatten(), r.asked).to_numpy(zero_copy_only=False)] = True
            at = np.flatnonzero(good)
            at = at[np.argsort(doc[at], kind="stable")]
            doc, term = doc[at], term[at]
            value = tf[at] * (k1 + 1) / (tf[at] + k1 * (1 - b + b * dl[at] / avgdl))
            step = max(1, CELLS // len(r.asked))
            for low in range(0, len(ids), step):
                cut = slice(*np.searchsorted(doc, [low, low + step]))
                yield from best.of(ids.slice(low, step), doc[cut] - low, term[cut], value[cut], queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, parts, seg = Best(request.value, k), [], None
            if not len(best.request.asked):
                return
            for batch in batches:
                segs = batch.column("seg").to_numpy()
                starts = [0, *(np.flatnonzero(segs[1:] != segs[:-1]) + 1).tolist()] if len(segs) else []
                for x, y in zip(starts, [*starts[1:], len(segs)], strict=True):
                    if parts and segs[x] != seg:
                        yield from scored(parts, best)
                        parts = []
                    seg = segs[x]
                    parts.append(batch.slice(x, y - x))
            if parts:
                yield from scored(parts, best)

        found = rows.repartition("seg").sortWithinPartitions("seg", "what", "term").mapInArrow(run, f"query_id {query_kind}, id {kind}, score double")
        return found.select("query_id", "id", F.round("score", 6).alias("score"))
