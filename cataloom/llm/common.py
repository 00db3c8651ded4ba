"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; with long texts the default of Spark (10,000) is too much for a worker.
ARROW_ROWS = 1000
#: Bytes of one Arrow batch.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bounds the rows and bytes of an Arrow batch, and so the memory of a task and its Python worker.

    Plans read these settings when they run, so they stay for the session; a lower setting of the user is left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        have = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b") or 0)
        if not 0 < have <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, as in tests, a temporary folder serves, but only if executors are threads of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """128 bits of the text, to tell rows with the same id but different texts apart."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads the bits of each value."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: dict[str, np.ndarray] = {}
#: Odd multiplier of the polynomial word hash.
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    have = _POW.get("p")
    if have is None or len(have) < n:
        size = max(n, 4096)
        p = np.full(size, np.uint64(_BASE))
        p[0] = 1
        _POW["p"] = have = np.multiply.accumulate(p)
    return have


#: Bytes that separate words: white space of ASCII.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by spaces; where each white-space separated word begins there, its bytes and its 64-bit hash; and each
    text's first place among the words (one more at the end)."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return joined, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts_of_text = np.concatenate(([0], np.cumsum(lengths + 1)))
    first = np.empty(len(solid), dtype=bool)
    first[0] = True
    np.not_equal(np.diff(solid), 1, out=first[1:])
    heads = np.flatnonzero(first)
    word_at = solid[heads]
    count = np.diff(np.append(heads, len(solid)))
    inside = np.arange(len(solid), dtype=np.int64) - np.repeat(heads, count)
    value = (data[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(count.max()))[inside]
    hashes = mix64(np.add.reduceat(value, heads) + count.astype(np.uint64))
    return joined, word_at, count, hashes, np.searchsorted(word_at, starts_of_text)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, and each text's first place in them (one more at the end)."""
    return word_spans(texts)[3:]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size values; fewer values than size give none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    p = _powers(size)
    out = hashes[:n].copy()
    for i in range(1, size):
        out += hashes[i : i + n] * p[i]
    return mix64(out)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def released() -> None:
    """Gives free memory of this process back to the system.

    Workers stay between tasks, and those that wait count in their executor's memory; freed arrays would stay with them otherwise.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about limit bytes of text each, one row at least. After the last, free memory goes back."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        group = np.cumsum(sizes) // limit if len(sizes) else sizes
        edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]))
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(int(a), int(b - a))
    released()
