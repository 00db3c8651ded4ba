"""Readers of records: JSON arrays, folders of them, CSV and append logs. Input order is explicit: _file and _seq."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def json_arrays(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, exclude: Sequence[str] = ()) -> DataFrame:
    """Records of files that each hold one JSON array, with _file, and _seq for the place in the file.

    A byte order mark is skipped; files that don't parse give no rows (see broken_files). A file is one row until it is split
    into records, so files should be of moderate size, as exports of one show are.
    """
    texts = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    for name in exclude:
        texts = texts.filter(~F.col("_file").endswith(f"/{name}"))
    parsed = texts.select("_file", F.from_json("value", T.ArrayType(schema)).alias("records"))
    return parsed.select("_file", F.posexplode("records").alias("_seq", "r")).filter("r IS NOT NULL").select("_file", F.col("_seq").cast("bigint").alias("_seq"), "r.*")


def json_maps(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(_file, _seq, record) with records as maps of texts, to look for fields that a schema lacks."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    parsed = texts.select("_file", F.from_json("value", "array<map<string,string>>").alias("records"))
    return parsed.select("_file", F.posexplode("records").alias("_seq", "record"))


def broken_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(_file) of files that hold no JSON array."""
    texts = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("_file"), F.regexp_replace("value", "^\\ufeff", "").alias("value"))
    return texts.filter(F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$[0]", "variant").isNull() & ~F.col("value").rlike(r"^\s*\[\s*\]\s*$"), F.lit(True))).select("_file")


def global_order(df: DataFrame) -> DataFrame:
    """_seq over all files, by file name and place: a file's places are moved by the number of records of the files before it.

    Only the counts of files go through one window.
    """
    counts = df.groupBy("_file").agg(F.count("*").alias("_n"))
    before = counts.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return df.join(F.broadcast(before), "_file").withColumn("_seq", F.col("_seq") + F.col("_before")).drop("_before")


def csv_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """A CSV file with header as texts; quotes may span lines, and a byte order mark before the first name is dropped."""
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def sniffed(columns: Sequence[str], *holding: str) -> str | None:
    """The first column whose name holds all of the words, in any case."""
    return next((c for c in columns if all(w.lower() in c.lower() for w in holding)), None)


def content_column(columns: Sequence[str], explicit: str | None = None, kind: str = "website") -> str | None:
    """The column with content: the given one, or one named by content and kind, or by kind, or by content."""
    if explicit:
        return explicit if explicit in columns else None
    return sniffed(columns, "content", kind) or sniffed(columns, kind) or sniffed(columns, "content")


def pipe_numbers(cell: Column) -> Column:
    """The numbers of a cell like 1|2|x."""
    return F.transform(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), F.trim), lambda x: x.rlike(r"^\d+$")), lambda x: x.try_cast("int"))


def checkpoint_log(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str, key: str) -> DataFrame:
    """The last record of each key of an append log of JSON lines; broken lines are skipped. Lines have their time in _seq, or else
    stand in the order of file names, and of places in a file: the block that was read and the line's number in it."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    columns = df.columns
    # a task reads a block from front to back, so the number grows inside one, whatever order Spark gives the blocks
    order = F.col("_seq") if "_seq" in columns else F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = df.select(F.struct(*columns).alias("r"), order.alias("_o"), F.col(key).alias("_k")).groupBy("_k").agg(F.max_by("r", "_o").alias("r"))
    return rows.select("r.*")


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely at path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
