"""Drill-down facets: each dimension is counted under the selections of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import Selection, matches


def taxonomy(catalogue: DataFrame) -> DataFrame:
    """(l1_id, l1_name, l2_id, l2_name) of all category trees; the name of the lowest row id wins."""
    l1 = catalogue.select("id", F.explode("cat_tree").alias("n")).select("id", "n.l1_id", "n.l1_name", F.explode("n.children").alias("c"))
    pairs = l1.select("id", "l1_id", "l1_name", F.col("c.id").alias("l2_id"), F.col("c.name").alias("l2_name"))
    return pairs.groupBy("l1_id", "l2_id").agg(F.min_by("l1_name", "id").alias("l1_name"), F.min_by("l2_name", "id").alias("l2_name"))


def names_of(pairs: DataFrame, level: int) -> DataFrame:
    """(value, label) of one level, the names in order."""
    return pairs.groupBy(F.col(f"l{level}_id").alias("value")).agg(F.min(f"l{level}_name").alias("label"))


def facet_cells(selection: Selection) -> Column:
    """The cells (dim, value) in which an entity counts under a selection.

    A dimension ignores its own selection; level 1 ignores level 2, too, and level 2 keeps level 1. Elements of expos count as often as
    they stand there.
    """
    dims = {
        "expos": (selection.without("expo"), F.col("expos")),
        "countries": (selection.without("countries"), F.array("hq_country")),
        "l1": (selection.without("l1", "l2"), F.transform("cat_l1_ids", lambda x: x.cast("string"))),
        "l2": (selection.without("l2"), F.transform("cat_l2_ids", lambda x: x.cast("string"))),
        "total": (selection, F.array(F.lit("all"))),
    }
    none = F.array().cast("array<string>")

    def named_values(dim: str, s: Selection, values: Column) -> Column:
        return F.transform(F.when(matches(s), values).otherwise(none), lambda v: F.struct(F.lit(dim).alias("dim"), v.alias("value")))

    return F.concat(*(named_values(d, s, values) for d, (s, values) in dims.items()))


def named_counts(counted: DataFrame, selection: Selection, pairs: DataFrame) -> DataFrame:
    """(dim, value, label, n) from counts (dim, value, n); of level 2 only children of the chosen level 1 stay."""
    if selection.l1:
        children = pairs.filter(F.col("l1_id").isin(list(selection.l1))).select(F.col("l2_id").cast("string").alias("value"), F.lit("l2").alias("dim")).distinct()
        counted = counted.filter("dim <> 'l2'").unionByName(counted.filter("dim = 'l2'").join(children, ["dim", "value"], "left_semi"))
    labels = names_of(pairs, 1).select(F.lit("l1").alias("dim"), F.col("value").cast("string").alias("value"), "label").unionByName(names_of(pairs, 2).select(F.lit("l2").alias("dim"), F.col("value").cast("string").alias("value"), "label"))
    out = counted.join(labels, ["dim", "value"], "left")
    return out.select("dim", "value", F.coalesce("label", F.when(F.col("dim").isin("l1", "l2"), "").otherwise(F.col("value"))).alias("label"), "n")


def facets(catalogue: DataFrame, selection: Selection, pairs: DataFrame) -> DataFrame:
    """(dim, value, label, n): counts of all dimensions and the total, from one pass over the catalogue, see facet_cells. Values without
    rows don't appear."""
    counted = catalogue.select(F.explode(facet_cells(selection)).alias("c")).groupBy("c.dim", "c.value").agg(F.count("*").alias("n"))
    return named_counts(counted, selection, pairs)


def ranked(counts: DataFrame) -> DataFrame:
    """Adds pos: the place of a value in its dimension by count, label and value."""
    return counts.withColumn("pos", F.row_number().over(Window.partitionBy("dim").orderBy(F.col("n").desc(), "label", "value")))


def shown(values: DataFrame, selected: list[str], cap: int) -> DataFrame:
    """How a panel lists a dimension: selected values first, then by count and label, at most cap."""
    return values.orderBy(F.col("value").isin(selected).desc(), F.col("n").desc(), "label", "value").limit(cap)
