"""Sparse and dense retrieval, fusion and reranking.

Filters hold before the top-k of each branch. Top-k plans keep k rows for each task (TakeOrderedAndProject), so no branch sorts the
corpus; ranks, fusion and reranking then work on at most two shortlists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import terms
from ..schema import CANDIDATES, DEFAULT_ALPHA, MIN_JUDGE_COVERAGE
from ..session import small_batches

#: Distinct terms of queries, and pairs of a query and a term, up to these numbers are broadcast.
BROADCAST_TERMS, BROADCAST_PAIRS = 200_000, 2_000_000
#: Cells (document, query) of a table of scores, and additions to it at once.
CELLS, ADDED = 4 << 20, 2 << 20
#: Queries in a block, about, and queries whose vectors are broadcast at most.
QUERY_BLOCK, BROADCAST_QUERIES = 1024, 10_000


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, *, k1: float = 1.2, b: float = 0.75, idf: bool = True, corpus: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of documents (id, text) for queries (query_id, text): those that share a term.

    Statistics (number of documents, their mean length, document frequencies) are those of corpus, docs by default, so a filter on
    docs doesn't change weights. A term that a query repeats counts once; rows with one id and one length are one document.

    The weights of a request are broadcast, and a document is scored where it is read, so nothing is shuffled; with k, a task gives no
    more than what can be among its k best of a query. Requests with more terms, or ids that repeat, are joined by term.
    """
    whole = docs if corpus is None else corpus
    wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    vocabulary = wanted.select("term").distinct()
    few = vocabulary.count() <= BROADCAST_TERMS
    if few:
        vocabulary = F.broadcast(vocabulary)
    if few and wanted.count() <= BROADCAST_PAIRS and all(_keyed(df) for df in {id(docs): docs, id(whole): whole}.values()):
        return _scored_in_place(docs, whole, wanted, vocabulary, k, k1, b, idf)

    def counted(df: DataFrame) -> DataFrame:
        words = df.select("id", terms(F.col("text")).alias("words")).select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
        return words.join(vocabulary, "term").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))

    tf = counted(docs)
    # one row that Spark computes with the rest
    tf = tf.join(F.broadcast(whole.agg(F.count("*").cast("double").alias("n_docs"), F.avg(F.size(terms(F.col("text")))).alias("avgdl"))))
    n, avgdl = F.col("n_docs"), F.coalesce("avgdl", F.lit(1.0))
    base = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    weight = base
    if idf:
        df = (tf if corpus is None else counted(corpus)).groupBy("term").agg(F.count("*").alias("df"))
        tf = tf.join(F.broadcast(df) if few else df, "term")
        weight = base * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(wanted, "term").groupBy("query_id", "id").agg(F.round(F.sum(weight), 6).alias("score"))


def _keyed(df: DataFrame) -> bool:
    """Whether each row has an id of its own."""
    rows, ids = df.agg(F.count("*"), F.count_distinct("id")).first()
    return rows == ids


@dataclass(frozen=True)
class Request:
    """The terms of queries, to be broadcast: names are the distinct terms in order, asked the queries; the pairs of a term lie together."""

    asked: pa.Array
    names: pa.Array
    query: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(weights: DataFrame) -> Request:
        """From (query_id, term, weight), one weight of each term."""
        rows = weights.toArrow().combine_chunks().sort_by("term")
        asked, names = (pa.compute.unique(rows[c].combine_chunks()) for c in ("query_id", "term"))
        query = pa.compute.index_in(rows["query_id"].combine_chunks(), asked).to_numpy(zero_copy_only=False)
        # of each term its first pair and the number of its pairs
        counts = np.bincount(pa.compute.index_in(rows["term"].combine_chunks(), names).to_numpy(zero_copy_only=False), minlength=len(names))
        first = np.cumsum(counts) - counts
        return Request(asked, names, query.astype(np.int64), rows["weight"].to_numpy()[first] if len(names) else np.zeros(0), first, counts)

    def term(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 if it isn't asked for."""
        return pa.compute.fill_null(pa.compute.index_in(words, self.names), -1).to_numpy(zero_copy_only=False)


class Best:
    """Scores of the documents that one task reads: all, or with k those that can be among its k best of a query."""

    def __init__(self, request: Request, k: int | None) -> None:
        self.request, self.k = request, k
        # what a query's k best of this task reach so far
        self.least = np.full(len(request.asked), -np.inf)

    def of(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, value: np.ndarray, queries: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) from postings in order of documents, numbers within ids: their terms and what each adds before its term's
        weight. queries tells for which queries these documents count."""
        r, n_queries = self.request, len(self.request.asked)
        value = r.weight[term] * value
        scores = np.zeros(len(ids) * n_queries)
        met = np.zeros(len(ids) * n_queries, bool)
        ends = np.cumsum(r.counts[term])
        i = 0
        while i < len(term):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ADDED, "right")))
            n = r.counts[term[i:j]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cells = np.repeat(doc[i:j] * n_queries, n) + r.query[np.repeat(r.first[term[i:j]], n) + nth]
            low = int(doc[i]) * n_queries
            sums = np.bincount(cells - low, np.repeat(value[i:j], n))
            scores[low : low + len(sums)] += sums
            met[cells] = True
            i = j
        scores, met = scores.reshape(-1, n_queries), met.reshape(-1, n_queries)
        if queries is not None:
            met &= queries
        if self.k and len(ids) >= self.k:
            self.least = np.maximum(self.least, np.partition(np.where(met, scores, -np.inf), -self.k, axis=0)[-self.k] - 1e-6)
        found, q = np.nonzero(met & (scores >= self.least))
        for a in range(0, len(q), 50_000):
            cut = slice(a, a + 50_000)
            yield pa.record_batch([r.asked.take(pa.array(q[cut])), ids.take(pa.array(found[cut])), pa.array(scores[found[cut], q[cut]])], names=["query_id", "id", "score"])


def _scored_in_place(docs: DataFrame, whole: DataFrame, wanted: DataFrame, vocabulary: DataFrame, k: int | None, k1: float, b: float, idf: bool) -> DataFrame:
    """bm25 for a vocabulary that is broadcast, from one document a row."""
    spark = docs.sparkSession
    small_batches(spark)
    n_docs, avgdl = whole.agg(F.count("*").cast("double"), F.coalesce(F.avg(F.size(terms(F.col("text")))), F.lit(1.0))).first()
    weights = wanted.withColumn("weight", F.lit(1.0))
    if idf:
        df = whole.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
        weights = wanted.join(F.broadcast(df), "term").select("query_id", "term", F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))
    request = spark.sparkContext.broadcast(Request.of(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = request.value
        best = Best(r, k)
        step = max(1, CELLS // max(1, len(r.asked)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(r.asked) else 0, step):
                part = batch.slice(at, step)
                lists = part.column("words")
                dl = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
                term = r.term(lists.flatten())
                cell = np.repeat(np.arange(len(dl)), dl) * len(r.names) + term
                keys, tf = np.unique(cell[term >= 0], return_counts=True)
                doc, term = np.divmod(keys, len(r.names))
                value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
                yield from best.of(part.column("id"), doc, term, value)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((wanted, "query_id"), (docs, "id"))]
    scored = docs.select("id", terms(F.col("text")).alias("words")).mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def distance(a: Column, b: Column, kind: str = "l2") -> Column:
    """Euclidean (l2) or Manhattan (l1) distance."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if kind == "l1":
        return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def with_queries(vectors: DataFrame, queries: DataFrame, parts: int = 64) -> DataFrame:
    """vectors with each of a stated set of queries (query_id, vector as q). Queries are broadcast up to BROADCAST_QUERIES; more are dealt
    to parts of the vectors."""
    asked = queries.withColumnRenamed("vector", "q")
    if asked.count() <= BROADCAST_QUERIES:
        return vectors.join(F.broadcast(asked), F.lit(True))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return vectors.withColumn("_part", part).join(asked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "_part").drop("_part")


def _packed(rows: DataFrame, key: str, ids: str, vectors: str) -> DataFrame:
    """Blocks (ids, vectors, dim) of the rows of each task's batches: the keys, and the vectors at length 1 as one row-major matrix.

    Null, empty and zero vectors, and those with a null, have no direction and are left out. Vectors of one length share a block.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            for dim in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == dim)
                m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dim))
                length = np.sqrt(np.einsum("ij,ij->i", m, m))
                good = np.isfinite(length) & (length > 0)
                if good.any():
                    keys = batch.column(key).take(pa.array(at[good]))
                    block = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
                    yield pa.record_batch([block, pa.array([(m[good] / length[good, None]).tobytes()], pa.binary()), pa.array([int(dim)], pa.int32())], names=[ids, vectors, "dim"])

    return rows.select(key, "vector").mapInArrow(run, f"{ids} array<{kind}>, {vectors} binary, dim int")


def dense(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, id, score): exact cosine similarity of vectors (id, vector) to a stated set of queries (query_id, vector).

    Both sides are packed into blocks of as many rows as an Arrow batch has, at most; each block of vectors meets each block of
    queries, and a pair of blocks is one matrix product. With k, a pair of blocks gives no more than the k best of each query, and
    those equal to the last of them in six digits. Blocks of queries are broadcast up to BROADCAST_QUERIES rows, and shuffled beyond.
    """
    n = queries.count()
    asked = _packed(queries.repartition(max(1, -(-n // QUERY_BLOCK))), "query_id", "qs", "q")
    if n <= BROADCAST_QUERIES:
        asked = F.broadcast(asked)
    pairs = _packed(vectors, "id", "ids", "v").join(asked.withColumnRenamed("dim", "qdim"), F.col("dim") == F.col("qdim"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "id"))]
    return matched_blocks(pairs.select("ids", "v", "dim", "qs", "q"), k, kinds)


def matched_blocks(pairs: DataFrame, k: int | None, kinds: Sequence[str]) -> DataFrame:
    """(query_id, id, score) from pairs of packed blocks (ids, v, dim, qs, q) by one matrix product each; kinds: types of the keys.

    With k, a pair of blocks gives no more than the k best of each query, and those equal to the last of them in six digits.
    """

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, ids, qs = batch.column("dim")[i].as_py(), batch.column("ids")[i].values, batch.column("qs")[i].values
                v, q = (np.frombuffer(batch.column(c)[i].as_py(), np.float64).reshape(-1, dim) for c in "vq")
                scores = q @ v.T
                if k and scores.shape[1] > k:
                    least = np.partition(scores, -k, axis=1)[:, -k, None] - 1e-6
                    query, vector = np.nonzero(scores >= least)
                else:
                    query, vector = (x.ravel() for x in np.indices(scores.shape))
                for a in range(0, len(query), 50_000):
                    part = slice(a, a + 50_000)
                    yield pa.record_batch([qs.take(pa.array(query[part])), ids.take(pa.array(vector[part])), pa.array(scores[query[part], vector[part]])], names=["query_id", "id", "score"])

    scored = pairs.mapInArrow(product, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return scored.select("query_id", "id", F.round("score", 6).alias("score"))


def top(scores: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best of each query with their rank from 1 on; ties go to the lower id.

    A window that keeps ranks up to k becomes a per-task limit before the shuffle.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rrf(*branches: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, score): the sum of 1 / (k + rank) over ranked branches."""
    return _summed([x.select("query_id", "id", (1 / (k + F.col("rank"))).alias("part")) for x in branches])


def dbsf(*branches: DataFrame, sample: bool = False) -> DataFrame:
    """Distribution-based fusion: each branch's scores between mean - 3 sd and mean + 3 sd as 0 to 1, then summed."""
    w = Window.partitionBy("query_id")
    sd = (F.stddev_samp if sample else F.stddev_pop)("score").over(w)
    mean = F.avg("score").over(w)
    part = F.when(F.coalesce(sd, F.lit(0.0)) < 1e-12, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("score") - (mean - 3 * sd)) / (6 * sd))))
    return _summed([x.select("query_id", "id", part.alias("part")) for x in branches])


def _summed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def fused(dense_branch: DataFrame, sparse_branch: DataFrame, method: str = "rrf") -> DataFrame:
    """Fusion by name: dbsf, or anything else for reciprocal ranks."""
    return (dbsf if method.lower() == "dbsf" else rrf)(dense_branch, sparse_branch)


def minmax(c: Column, w: Window) -> Column:
    """Between 0 and 1 over the window; constant values are 0.5."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low < 1e-12, 0.5).otherwise((c - low) / (high - low))


def zscore(c: Column, w: Window) -> Column:
    """Standard scores with the population's deviation; 0 where it is nothing."""
    sd = F.stddev_pop(c).over(w)
    return F.when(sd < 1e-12, 0.0).otherwise((c - F.avg(c).over(w)) / sd)


def rerank(shortlist: DataFrame, judged: DataFrame, *, alpha: float = DEFAULT_ALPHA, normalise: str = "minmax", top_n: int | None = None) -> DataFrame:
    """Blends retrieval with a judge's scores (query_id, id, judge), alpha for retrieval.

    shortlist has query_id, id, score and rank. Scores are normalised as rounded to four digits. If fewer than MIN_JUDGE_COVERAGE of
    a query's rows have a judgement, or there is a single row, the order stays and the added columns are null. A row without
    judgement gets the mean of the judged. Judgements outside the shortlist count for coverage. Of repeated ones the last wins if
    judged has their place as pos, and else the highest.
    Adds retrieval_norm, llm_score, final_score and position.
    """
    alpha = min(max(alpha, 0.0), 1.0)
    w = Window.partitionBy("query_id")
    scores = judged.groupBy("query_id", "id").agg((F.max_by("judge", "pos") if "pos" in judged.columns else F.max("judge")).alias("judge"))
    given = scores.groupBy("query_id").agg(F.count("*").alias("given"))
    rows = shortlist.join(scores, ["query_id", "id"], "left").join(given, "query_id", "left")
    size = F.count("*").over(w)
    rows = rows.withColumn("used", (size > 1) & (F.coalesce("given", F.lit(0)) / size >= MIN_JUDGE_COVERAGE))
    raw = F.round("score", 4)
    base = zscore(raw, w) if normalise == "zscore" else minmax(raw, w)
    mean = F.coalesce(F.avg("judge").over(w), F.lit(0.5))
    filled = F.coalesce("judge", mean)
    judge = zscore(filled, w) if normalise == "zscore" else filled
    blended = rows.withColumns({"retrieval_norm": base, "blend": alpha * base + (1 - alpha) * judge})
    out = blended.select(
        *shortlist.columns,
        F.when(F.col("used"), F.round("retrieval_norm", 4)).alias("retrieval_norm"),
        F.when(F.col("used"), F.round("judge", 3)).alias("llm_score"),
        F.when(F.col("used"), F.round("blend", 4)).alias("final_score"),
    )
    order = w.orderBy(F.col("final_score").desc_nulls_last(), "rank")
    out = out.withColumn("position", F.row_number().over(order))
    return out.filter(F.col("position") <= top_n) if top_n else out


def explained(shortlist: DataFrame, explanations: DataFrame, default: str) -> DataFrame:
    """Adds reason by id as text, and a default sentence where there is none."""
    named = explanations.select(F.col("id").cast("string").alias("eid"), "reason").groupBy("eid").agg(F.max("reason").alias("reason"))
    return shortlist.join(named, shortlist["id"].cast("string") == named["eid"], "left").drop("eid").withColumn("reason", F.coalesce("reason", F.lit(default)))
