"""Connected components of a link table by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, name: str) -> DataFrame:
    """(a, b) with b < a: every vertex linked to the lowest of those it meets."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return written(links.join(low, "a").select(F.col("b").alias("v"), F.least("a", "m").alias("m")).union(low.select(F.col("a").alias("v"), F.least("a", "m").alias("m"))).filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), name)


def components(links: DataFrame) -> DataFrame:
    """(v, root) of each vertex of links (a, b) that isn't the lowest of its component, root being that lowest vertex.

    Large stars link a vertex's higher neighbours to its lowest one, small stars its lower neighbours; both shrink the depth of
    each component until all hang on its lowest vertex. Links may repeat and go either way; those from a vertex to itself don't
    count. Without links there are no rows.
    """
    current = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = written(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct(), "large-star")
        current = _star(large, "small-star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return current.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = state
