"""Incremental catalogue: new records are folded into the entities they belong to, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import name_key


def upsert(spark: SparkSession, batch: DataFrame, state: str, buckets: int = 32) -> None:
    """Adds records (with _seq) to the record table at state, kept by bucket of their merge key; a record with the same key and _seq
    replaces the one before, so a batch that is repeated after a failure changes nothing. Only buckets with new records are written,
    each as a new folder of files."""
    keyed = batch.withColumn("_key", name_key(F.col("company_name"))).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    touched = [r["_bucket"] for r in keyed.select("_bucket").distinct().collect()]
    if not touched:
        return
    try:
        old = spark.read.parquet(state).filter(F.col("_bucket").isin(touched)).select(*keyed.columns)
    except Exception as e:  # noqa: BLE001  the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    both = keyed.withColumn("_new", F.lit(1))
    if old is not None:
        both = both.unionByName(old.withColumn("_new", F.lit(0)))
    kept = both.groupBy("_bucket", "_key", "_seq").agg(F.max_by(F.struct(*[c for c in keyed.columns if c not in ("_bucket", "_key", "_seq")]), "_new").alias("r")).select("_bucket", "_key", "_seq", "r.*")
    # checkpoint() cuts the plan from the folders that are overwritten
    kept = kept.checkpoint()
    kept.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(state)


def follow(spark: SparkSession, folder: str, schema: T.StructType, state: str, checkpoint: str, *, buckets: int = 32) -> StreamingQuery:
    """Reads all new JSON-lines files of folder once and upserts them; run it again for what comes later."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(lambda df, _: upsert(spark, df, state, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; on a stream, later ones than late are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
