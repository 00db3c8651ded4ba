"""Token ids as raw shards, with a minimal perfect hash index from document keys to shard offsets.

Files below the store's folder:

* ``shard-NNNNNN.ids``: raw little-endian ids (16 bits where the vocabulary allows it, else 32) of documents in ascending key order;
* ``shard-NNNNNN.off``: the place in ids where each record begins, and the end, as little-endian 64-bit integers;
* ``records``: Parquet with (k, shard, record, at, n) of each record;
* ``index-NNNNNN.mph``: one minimal perfect hash function for a bucket of keys, and an entry for each of its keys.

The index is built by bucket of hashed keys, about KEYS_PER_BUCKET each, so no task holds more than that. A function has levels
of bit arrays: a key belongs to the first level where no other key of the bucket has its bit, and its slot is the number of bits
set before. An entry holds a fingerprint from another hash of the key, so that strange keys are told apart, and where the key's records
stand. Keys that share their 64-bit hash with another are listed behind the function, with entries of their own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import pieces
from .common import by_bytes, mix64, shared_dir, small_batches, texts_of

#: Keys for which one task builds a hash function.
KEYS_PER_BUCKET = 50_000
#: Bits of a level for each key that is left, and the most levels.
LEVEL_BITS, LEVELS = 2.0, 40
BATCH_BYTES = 4 << 20

ENTRY = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("count", "<u8")])


@dataclass(frozen=True)
class Store:
    """A written store: its folder, the dtype of ids and the number of index buckets."""

    path: str
    dtype: str
    buckets: int


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _put(fs: pa.fs.FileSystem, path: str, attempt: int, data: bytes) -> None:
    """Writes a whole file; a later attempt of the same task replaces it by the same bytes."""
    with fs.open_output_stream(part := f"{path}.{attempt}") as out:
        out.write(data)
    fs.move(part, path)


# --- the hash function ---------------------------------------------------------------------------------------------------


def _level_hash(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


def build_mph(hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Levels of bits, hashes that found no level, and the slot of each hash. hashes: distinct."""
    slots = np.full(len(hashes), -1, np.int64)
    left = np.arange(len(hashes))
    levels: list[np.ndarray] = []
    base = 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, int(LEVEL_BITS * len(left)))
        at = _level_hash(hashes[left], level, size)
        bits = np.bincount(at, minlength=size) == 1
        alone = bits[at]
        slots[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(bits.sum())
        levels.append(bits)
        left = left[~alone]
    rest = np.sort(hashes[left])
    slots[left] = base + np.searchsorted(rest, hashes[left])
    return levels, rest, slots


def _pack(h: np.ndarray, g: np.ndarray, places: dict[str, np.ndarray]) -> bytes:
    """A file of the keys with hashes h, other hashes g for fingerprints, and the places of their records."""
    entries = np.zeros(len(h), ENTRY)
    entries["fp"] = _fingerprint(g)
    for c, v in places.items():
        entries[c] = v
    alone, first = np.unique(h, return_index=True)
    more = np.ones(len(h), bool)
    more[first] = False
    more = np.flatnonzero(more)[np.argsort(h[more], kind="stable")]
    levels, rest, slots = build_mph(alone)
    placed = np.zeros(len(alone), ENTRY)
    placed[slots] = entries[first]
    head = struct.pack("<IIII", len(levels), len(rest), len(placed), len(more)) + b"".join(struct.pack("<I", len(b)) for b in levels)
    return head + b"".join([*(np.packbits(b).tobytes() for b in levels), rest.astype("<u8").tobytes(), h[more].astype("<u8").tobytes(), placed.tobytes(), entries[more].tobytes()])


class Mph:
    """A hash function and its entries, read from a file's bytes."""

    def __init__(self, data: bytes):
        n, n_rest, n_entries, n_more = struct.unpack_from("<IIII", data)
        sizes = struct.unpack_from(f"<{n}I", data, 16)
        at = 16 + 4 * n
        self.bits, self.ranks, base = [], [], 0
        for size in sizes:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool)
            at += -(-size // 8)
            self.bits.append(bits)
            self.ranks.append(base + np.cumsum(bits) - 1)
            base += int(bits.sum())
        self.rest = np.frombuffer(data, "<u8", n_rest, at)
        self.more = np.frombuffer(data, "<u8", n_more, at + 8 * n_rest)
        self.base, self.alone = base, n_entries
        self.entries = np.frombuffer(data, ENTRY, n_entries + n_more, at + 8 * (n_rest + n_more))

    def find(self, hashes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The slot of each key by its two hashes, or -1 where its fingerprint isn't that of the slot."""
        slots = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            if not len(left):
                break
            at = _level_hash(hashes[left], level, len(bits))
            hit = bits[at]
            slots[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, hashes[left]), len(self.rest) - 1)
            found = self.rest[at] == hashes[left]
            slots[left[found]] = self.base + at[found]
        fp, good = _fingerprint(others), slots >= 0
        good[good] = self.entries["fp"][slots[good]] == fp[good]
        for i in np.flatnonzero(~good & np.isin(hashes, self.more)):
            same = self.alone + np.flatnonzero(self.more == hashes[i])
            hit = same[self.entries["fp"][same] == fp[i]]
            if len(hit):
                slots[i], good[i] = hit[0], True
        return np.where(good, slots, -1)


def _fingerprint(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(32)).astype("<u4")


def _key_hashes(key: str) -> tuple[Column, Column]:
    """The hash of a key, and another that doesn't follow from it."""
    return F.xxhash64(F.col(key).isNull(), F.col(key)).alias("h"), F.xxhash64(F.lit("fingerprint"), F.col(key)).alias("g")


# --- writing -------------------------------------------------------------------------------------------------------------


def write_store(docs: DataFrame, tokenizer_path: str, *, end_id: int, path: str | None = None, shards: int | None = None, key: str = "doc_id", text: str = "text") -> Store:
    """Encodes every whole text, with end_id after each document, and writes shards and index in ascending key order.

    A null or empty text is a record of end_id alone. A null key sorts first and is a key like others. Repeated keys stand side
    by side in one shard, in the order of their texts; the index leads to the first and tells how many there are. Other columns
    of docs are not read. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "tokens")
    _files(path)[0].create_dir(_files(path)[1])
    dtype = "<u2" if max(pieces.Encoder(tokenizer_path).size - 1, end_id) < 1 << 16 else "<u4"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        task = TaskContext.get()
        name, part = f"{root}/shard-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        table, at = pieces.pieces(tokenizer_path), 0
        starts = [np.zeros(1, np.int64)]
        out = None
        for batch in by_bytes(batches, "t", BATCH_BYTES):
            out = out or fs.open_output_stream(name + part)
            ids, n = table.ids(texts_of(batch.column("t")))
            owner, n = np.repeat(np.arange(len(n)), n), n + 1
            payload = np.full(int(n.sum()), end_id, dtype)
            payload[np.arange(len(ids)) + owner] = ids
            out.write(payload.tobytes())
            begin, first = at + np.cumsum(n) - n, sum(map(len, starts)) - 1
            at += int(n.sum())
            starts.append(begin + n)
            yield pa.record_batch([batch.column("k"), pa.array(np.full(len(n), task.partitionId(), np.int32)), pa.array(np.arange(first, first + len(n))), pa.array(begin), pa.array(n)], names=["k", "shard", "record", "at", "n"])
        if out:
            out.close()
            fs.move(name + part, name + ".ids")
            _put(fs, name + ".off", task.taskAttemptId(), np.concatenate(starts).astype("<i8").tobytes())

    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").repartitionByRange(n, "k").sortWithinPartitions("k", "t")
    rows.mapInArrow(shard, f"k {kind}, shard int, record long, at long, n long").write.parquet(f"{path}/records")

    records = spark.read.schema(f"k {kind}, shard int, record long, at long, n long").parquet(f"{path}/records")
    keys = records.groupBy("k").agg(F.min("shard").alias("shard"), F.min("record").alias("record"), F.count("*").alias("count"))
    buckets = max(1, -(-records.count() // KEYS_PER_BUCKET))

    def index(batch: pa.Table) -> pa.Table:
        fs, root = _files(path)
        h, g = (np.asarray(batch.column(c)).astype(np.uint64) for c in "hg")
        bucket = batch.column("bucket")[0].as_py()
        _put(fs, f"{root}/index-{bucket:06d}.mph", TaskContext.get().taskAttemptId(), _pack(h, g, {c: np.asarray(batch.column(c)) for c in ("shard", "record", "count")}))
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "keys": pa.array([len(h)], pa.int64())})

    hashed = keys.select("*", *_key_hashes("k")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    hashed.select("bucket", "h", "g", "shard", "record", "count").groupBy("bucket").applyInArrow(index, "bucket long, keys long").write.parquet(f"{path}/buckets")
    return Store(path, dtype, buckets)


# --- reading -------------------------------------------------------------------------------------------------------------


def locate(keys: DataFrame, store: Store, key: str = "doc_id") -> DataFrame:
    """Where the records of each distinct key stand, by the index alone: (k, shard, record, count); keys that the store lacks are left out.

    A null key is looked up like others. An index file is read once for each bucket that has keys.
    """
    kind = keys.schema[key].dataType.simpleString()
    path = store.path

    def find(batch: pa.Table) -> pa.Table:
        fs, root = _files(path)
        name = f"{root}/index-{batch.column('bucket')[0].as_py():06d}.mph"
        if fs.get_file_info(name).type == pa.fs.FileType.NotFound:
            batch = batch.slice(0, 0)
            slots, entries = np.zeros(0, np.int64), np.zeros(0, ENTRY)
        else:
            with fs.open_input_stream(name) as f:
                mph = Mph(f.read())
            slots, entries = mph.find(*(np.asarray(batch.column(c)).astype(np.uint64) for c in "hg")), mph.entries
        found = entries[slots[slots >= 0]]
        return pa.table({"k": batch.column("k").filter(pa.array(slots >= 0)), "shard": found["shard"].astype(np.int32), "record": found["record"].astype(np.int64), "count": found["count"].astype(np.int64)})

    # a shuffled key set is distinct by hash, so that a bucket is as small as in the index
    distinct = keys.selectExpr(f"`{key}` AS k").distinct().select("*", *_key_hashes("k")).withColumn("bucket", F.pmod("h", F.lit(store.buckets)))
    return distinct.groupBy("bucket").applyInArrow(find, f"k {kind}, shard int, record long, count long")


def read_records(located: DataFrame, store: Store, *, payload: bool = False) -> DataFrame:
    """Reads the located records from the shards: (k, shard, record, at, n, ids_crc32), with the raw ids as binary if payload.

    ids_crc32 is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers. A shard is read from front to back, a
    record at a time.
    """
    path, dtype = store.path, np.dtype(store.dtype)
    kind = located.schema["k"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        shard, starts, data = -1, None, None
        for batch in batches:
            rows: list[tuple] = []
            for k, s, record, count in zip(*(batch.column(c).to_pylist() for c in ("k", "shard", "record", "count")), strict=True):
                if s != shard:
                    with fs.open_input_stream(f"{root}/shard-{s:06d}.off") as f:
                        starts = np.frombuffer(f.read(), "<i8")
                    if data is not None:
                        data.close()
                    data, shard = fs.open_input_file(f"{root}/shard-{s:06d}.ids"), s
                for r in range(record, record + count):
                    at, end = int(starts[r]), int(starts[r + 1])
                    raw = data.read_at((end - at) * dtype.itemsize, at * dtype.itemsize)
                    rows.append((k, s, r, at, end - at, zlib.crc32(np.frombuffer(raw, dtype).astype("<u4")), raw if payload else None))
                    if len(rows) >= 2000:
                        yield _rows(rows, batch.schema.field("k").type)
                        rows = []
            if rows:
                yield _rows(rows, batch.schema.field("k").type)

    def _rows(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k", "shard", "record", "at", "n", "ids_crc32", "ids"])

    rows = located.repartition("shard").sortWithinPartitions("shard", "record")
    out = rows.mapInArrow(read, f"k {kind}, shard int, record long, at long, n long, ids_crc32 long, ids binary")
    return out if payload else out.drop("ids")


def token_table(docs: DataFrame, tokenizer_path: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes a store of docs, looks every key up in its index, reads the files back and tells of each record: key, start (ids of
    all records before it), n_tokens (with the end id) and ids_crc32. See write_store for nulls, ties and empty tables."""
    spark: SparkSession = docs.sparkSession
    store = write_store(docs, tokenizer_path, end_id=end_id, key=key, text=text)
    records = spark.read.parquet(f"{store.path}/records")
    # one row for each shard, and so few rows in the window
    base = records.groupBy("shard").agg(F.sum("n").alias("ids")).select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    read = read_records(locate(docs, store, key), store)
    return read.join(base, "shard").select(F.col("k").alias(key), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", "shard", "record")
