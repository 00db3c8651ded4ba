"""An inverted-file index of vectors: lists by trained centroids, search of the nearest lists, exact scores, and an exact way on top.

Vectors are stored at length 1 as packed matrices in folders by list, so a search reads its lists' folders only, and a list and the
queries that probe it meet in one matrix product. For unit vectors the angle to the centroid obeys the triangle inequality: no vector of
a list with radius r is nearer to a query than its centroid's angle less r. The exact way reads, after the nearest lists, those lists
that this bound doesn't exclude, and gives what retrieve.dense gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import stored
from .retrieve import BROADCAST_QUERIES, matched_blocks, top

#: Vectors for training, at most, chosen by a hash of their ids; the driver holds them.
TRAIN_ROWS = 20_000
#: Lists at most: their centroids are broadcast.
MOST_LISTS = 4096
#: Vectors of a packed block, and queries of one.
BLOCK = 1024
#: The list of vectors whose length isn't that of the centroids; every search reads it.
OTHER = -1
#: Angles are compared with this tolerance: scores are rounded to six digits.
_ANGLE = 2e-3


def _matrix(lists: pa.ListArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, matrix, sizes): the rows with a direction, at length 1, among those with dim numbers; and the sizes of all rows."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    at = np.flatnonzero(sizes == dim)
    m = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(length) & (length > 0)
    return at[good], m[good] / length[good, None], sizes


def train(vectors: DataFrame, *, lists: int | None = None, rows: int = TRAIN_ROWS, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of length 1 by spherical k-means on at most rows vectors (id, vector) of the most frequent length in the sample.

    lists is by default the square root of the number of vectors, MOST_LISTS at most; there are no more than vectors in the sample.
    """
    n = vectors.count()
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    sample = vectors.filter("size(vector) > 0").select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(rows).select("vector").toArrow().column("vector").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(sample))
    if not len(sizes):
        return np.zeros((0, 1))
    values, counts = np.unique(sizes, return_counts=True)
    x = _matrix(sample, int(values[counts.argmax()]))[1]
    if not len(x):
        return np.zeros((0, 1))
    r = np.random.default_rng(seed)
    c = np.unique(x, axis=0)
    c = c[r.permutation(len(c))[:lists]]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        # a list that lost its vectors takes one that is far from its own centroid
        far = np.argsort(np.einsum("ij,ij->i", x, c[nearest]))
        for i, lost in enumerate(np.flatnonzero(length < 1e-9)):
            sums[lost], length[lost] = x[far[i % len(far)]], 1.0
        c = sums / length[:, None]
    return c


def build(vectors: DataFrame, path: str, *, centroids: np.ndarray | None = None, **training: int) -> VectorIndex:
    """Writes the index of vectors (id, vector) below path: packed blocks by list, then the lists with centroids and radii.

    Vectors without a direction (null, empty, zero or with a null) are left out, as in retrieve.dense. Blocks are made of what a task
    has of a list, so a list may be of any size; it is written in as many blocks and read by as many tasks as it needs.
    """
    spark = vectors.sparkSession
    centroids = train(vectors, **training) if centroids is None else centroids
    sent = spark.sparkContext.broadcast(centroids)
    kind = vectors.schema["id"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            dims = pa.compute.fill_null(pa.compute.list_value_length(batch.column("vector")), 0)
            for dim in sorted({x for x in dims.to_pylist() if x}):
                at, m, _ = _matrix(batch.column("vector"), dim)
                if not len(at):
                    continue
                if len(c) and dim == c.shape[1]:
                    near = m @ c.T
                    which = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(m)), which], -1, 1))
                else:
                    which, angle = np.full(len(m), OTHER), np.zeros(len(m))
                ids = batch.column("id").take(pa.array(at))
                for i in np.unique(which):
                    rows = np.flatnonzero(which == i)
                    for a in range(0, len(rows), BLOCK):
                        part = rows[a : a + BLOCK]
                        block = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(part)))
                        yield pa.record_batch([pa.array([int(i)], pa.int32()), pa.array([dim], pa.int32()), block, pa.array([m[part].tobytes()], pa.binary()), pa.array([float(angle[part].max())])], names=["list", "dim", "ids", "v", "angle"])

    blocks = vectors.select("id", "vector").mapInArrow(assigned, f"list int, dim int, ids array<{kind}>, v binary, angle double")
    blocks.repartition("list").sortWithinPartitions("list").write.mode("overwrite").option("maxRecordsPerFile", 4096).partitionBy("list").parquet(f"{path}/blocks")
    written = spark.read.schema(f"dim int, ids array<{kind}>, v binary, angle double, list int").parquet(f"{path}/blocks")
    centre = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centroids)], "list int, centroid array<double>")
    sizes = written.groupBy("list").agg(F.sum(F.size("ids")).alias("n"), F.max("angle").alias("radius"))
    sizes.join(centre, "list", "left").withColumn("kind", F.lit(kind)).coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return VectorIndex(spark, path)


@dataclass(frozen=True)
class VectorIndex:
    """An index that build has written."""

    spark: SparkSession
    path: str

    @property
    def lists(self) -> DataFrame:
        """(list, n, radius, centroid, kind), kind being the type of ids; a list without vectors isn't there, and OTHER has no centroid."""
        return self.spark.read.schema("list int, n long, radius double, centroid array<double>, kind string").parquet(f"{self.path}/lists")

    def _near(self, queries: DataFrame, most: int | None) -> DataFrame:
        """(query_id, list, place, angle, radius): each query's lists in order of their angle, from 1 on, the first most of them. OTHER,
        which any query reads, has place 0. Lists are MOST_LISTS at most."""
        rows = self.lists.orderBy("list").collect()
        known = [r for r in rows if r["list"] != OTHER]
        other = len(known) < len(rows)
        sent = self.spark.sparkContext.broadcast((np.array([r["list"] for r in known], np.int32), np.array([r["radius"] for r in known]), np.array([r["centroid"] for r in known], np.float64)))
        kind = queries.schema["query_id"].dataType.simpleString()
        fields = ["query_id", "list", "place", "angle", "radius"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, radii, c = sent.value
            for batch in batches:
                dims = pa.compute.fill_null(pa.compute.list_value_length(batch.column("vector")), 0)
                for dim in sorted({x for x in dims.to_pylist() if x}):
                    at, m, _ = _matrix(batch.column("vector"), dim)
                    ids = batch.column("query_id").take(pa.array(at))
                    if other:
                        zero = np.zeros(len(at))
                        yield pa.record_batch([ids, pa.array(zero + OTHER, pa.int32()), pa.array(zero, pa.int32()), pa.array(zero), pa.array(zero)], names=fields)
                    if not len(names) or c.shape[1] != dim:
                        continue
                    for x in range(0, len(m), BLOCK):
                        angle = np.arccos(np.clip(m[x : x + BLOCK] @ c.T, -1, 1))
                        order = np.argsort(angle, axis=1, kind="stable")[:, :most]
                        n, size = order.shape
                        place = np.tile(np.arange(1, size + 1), n)
                        query = pa.array(np.repeat(np.arange(x, x + n), size))
                        yield pa.record_batch([ids.take(query), pa.array(names[order].ravel()), pa.array(place, pa.int32()), pa.array(np.take_along_axis(angle, order, 1).ravel()), pa.array(radii[order].ravel())], names=fields)

        return queries.select("query_id", "vector").mapInArrow(run, f"query_id {kind}, list int, place int, angle double, radius double")

    def _scored(self, wanted: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
        """(query_id, id, score) of wanted (query_id, list): the queries with all vectors of their lists."""
        kind = queries.schema["query_id"].dataType.simpleString()

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = np.asarray(batch.column("list"))
                dims = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column("vector")), 0))
                for dim in np.unique(dims[dims > 0]):
                    at, m, _ = _matrix(batch.column("vector"), int(dim))
                    for i in np.unique(lists[at]):
                        rows = np.flatnonzero(lists[at] == i)
                        for x in range(0, len(rows), BLOCK):
                            part = rows[x : x + BLOCK]
                            block = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), batch.column("query_id").take(pa.array(at[part])))
                            yield pa.record_batch([pa.array([int(i)], pa.int32()), pa.array([int(dim)], pa.int32()), block, pa.array([m[part].tobytes()], pa.binary())], names=["list", "qdim", "qs", "q"])

        few = wanted.count() <= BROADCAST_QUERIES
        rows = wanted.join(queries.select("query_id", "vector"), "query_id").repartition("list").sortWithinPartitions("list")
        asked = rows.select("query_id", "list", "vector").mapInArrow(packed, f"list int, qdim int, qs array<{kind}>, q binary")
        first = self.lists.select("kind").first()
        ids = first["kind"] if first else "bigint"
        blocks = self.spark.read.schema(f"dim int, ids array<{ids}>, v binary, angle double, list int").parquet(f"{self.path}/blocks")
        both = blocks.join(F.broadcast(asked) if few else asked, (blocks["list"] == asked["list"]) & (F.col("dim") == F.col("qdim")))
        return matched_blocks(both.select("ids", "v", "dim", "qs", "q"), k, (kind, ids))

    def search(self, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k nearest of the vectors in the probes nearest lists, by exact cosine similarity.

        With exact, all lists that may hold one of the k best are read as well, in a second step, and the result is that of all
        vectors. Pairs of queries and lists are broadcast up to BROADCAST_QUERIES, and shuffled beyond.
        """
        near = stored(self._near(queries, None if exact else probes), "near-lists")
        found = stored(top(self._scored(near.filter(F.col("place") <= probes).select("query_id", "list"), queries, k), k), "nearest")
        if not exact:
            return found
        # the angle of the k-th best so far; fewer than k exclude nothing
        least = found.filter(F.col("rank") == k).select("query_id", F.acos(F.least(F.greatest("score", F.lit(-1.0)), F.lit(1.0))).alias("reach"))
        rest = near.filter(F.col("place") > probes).join(least, "query_id", "left")
        rest = stored(rest.filter(F.col("reach").isNull() | _may_hold(F.col("angle"), F.col("radius"), F.col("reach"))).select("query_id", "list"), "further-lists")
        return top(found.select("query_id", "id", "score").union(self._scored(rest, queries, k)), k)


def _may_hold(angle: Column, radius: Column, reach: Column) -> Column:
    """Whether a list can hold a vector nearer than reach."""
    return angle - radius <= reach + _ANGLE
