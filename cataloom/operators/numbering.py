"""Dense numbers over whole tables, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored


def numbered(df: DataFrame, *order: Column | str, name: str = "_n") -> DataFrame:
    """df with the place of each row, from 0 on, in the order of the given columns.

    Rows are sorted in ranges, each range counts its rows, and a range begins with the sum of the counts before it; only one number for
    each range goes to the driver. Rows that tie have places side by side, in any order.
    """
    spark = df.sparkSession
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # the lower bits of this id count the rows of a partition
    placed = stored(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")
    begins, total = [], 0
    for r in placed.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        begins.append((r["_range"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(begins, "_range int, _begin long"))
    return placed.join(starts, "_range").withColumn(name, F.col("_begin") + F.col("_at")).drop("_range", "_at", "_begin")
