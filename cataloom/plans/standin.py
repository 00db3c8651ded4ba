"""The given tables as a supplier catalogue: suppliers are companies, nations their countries, years of deliveries the shows,
brands level-1 categories, and brands with sizes level-2 categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import catalogue_view

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, company_name, hq_country, expos, cat_l1_ids, cat_l2_ids and cat_tree of each supplier."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("l1"), "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").cast("string").alias("expo"))
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), "expo", "l1", (F.col("l1") * 100 + F.col("p_size")).cast("int").alias("l2"), "p_size")
    per_l1 = rows.groupBy("id", "l1").agg(F.array_sort(F.collect_set("expo")).alias("expos"), F.array_sort(F.collect_set(F.struct(F.col("l2").alias("id"), F.concat(F.lit("Size "), F.col("p_size").cast("string")).alias("name")))).alias("children"))
    node = F.struct(F.col("l1").alias("l1_id"), F.concat(F.lit("Brand "), F.col("l1").cast("string")).alias("l1_name"), "children")
    facts = per_l1.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("expos")))).alias("expos"), F.sort_array(F.collect_list(node)).alias("cat_tree"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("hq_country"))
    suppliers = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("company_name"), "hq_country")
    out = suppliers.join(facts, "id", "left")
    return catalogue_view(out.withColumns({"cat_l1_ids": F.col("cat_tree.l1_id"), "cat_l2_ids": F.flatten(F.transform("cat_tree", lambda n: n["children"]["id"]))}))


#: The same as DuckDB SQL: lines (id, y, l1, l2, size) and cat (id, company_name, hq_country, expos, l1, l2).
SQL = """
lines AS (SELECT l_suppkey AS id, year(l_shipdate)::VARCHAR AS y, replace(p_brand, 'Brand#', '')::INTEGER AS l1, (replace(p_brand, 'Brand#', '')::INTEGER * 100 + p_size)::INTEGER AS l2, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey),
facts AS (SELECT id, list(DISTINCT y) AS expos, list(DISTINCT l1) AS l1, list(DISTINCT l2) AS l2 FROM lines GROUP BY id),
cat AS (SELECT s_suppkey AS id, s_name AS company_name, coalesce(n_name, 'Unknown') AS hq_country, coalesce(expos, ['Unknown']) AS expos, coalesce(l1, []) AS l1, coalesce(l2, []) AS l2
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN facts ON s_suppkey = id)"""
