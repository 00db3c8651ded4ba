"""Is it there already? Tables that are rebuilt only when their inputs, their schema or their settings changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .commits import Commits


def fingerprint(inputs: Sequence[DataFrame], settings: Mapping[str, object] = {}) -> str:  # noqa: B006
    """A hash of the input files (place, length, time of change), the inputs' schemas and the settings."""
    digest = hashlib.sha256(json.dumps(dict(settings), sort_keys=True, default=str).encode())
    for df in inputs:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        files = df.inputFiles()
        if not files:
            raise ValueError("an input without files has no fingerprint; write it first")
        for f in sorted(files):
            p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
            s = p.getFileSystem(conf).getFileStatus(p)
            digest.update(f"{f}:{s.getLen()}:{s.getModificationTime()}\n".encode())
        digest.update(df.schema.json().encode())
    return digest.hexdigest()


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame], inputs: Sequence[DataFrame], settings: Mapping[str, object] = {}, *, force: bool = False) -> DataFrame:  # noqa: B006
    """The table at path, built if there is none of these inputs and settings, or with force.

    A table is written to a folder of its own and counts once its manifest is committed, so a half-written one is never read, and readers
    of the one before aren't disturbed. Folders of earlier manifests go after the commit, but for the last one.
    """
    commits = Commits(spark, path)
    now = fingerprint(inputs, settings)
    number, last = commits.last()
    if last.get("fingerprint") == now and not force:
        return spark.read.schema(StructType.fromJson(last["schema"])).parquet(last["folder"])
    folder = commits.folder("table")
    df = build()
    df.write.parquet(folder)
    commit = {"fingerprint": now, "folder": folder, "before": last.get("folder"), "schema": df.schema.jsonValue()}
    while not commits.add(number + 1, commit):
        number, last = commits.last()
    if last.get("before"):
        commits.remove(last["before"])
    return spark.read.schema(df.schema).parquet(folder)
