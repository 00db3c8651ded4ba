"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which goes when the application ends. Where that isn't set, one below a temporary folder,
    if executors are threads of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # deleteOnExit knows only what is there
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, so that it is computed once and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Lets go of the shuffle files of plans that nothing refers to any more, as after stored; Spark's cleaner removes them when the driver
    collects its garbage."""
    spark.sparkContext._jvm.System.gc()
