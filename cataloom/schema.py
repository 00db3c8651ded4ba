"""Schemas and constants of the catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

# Sentinels, limits and defaults that all parts share.
FALLBACK_ABOUT = "Semiconductor technology and equipment supplier."
UNKNOWN_COUNTRY = "Unknown"
ALL_EXPOS = "All"
MISSING_URL = "#"
MIN_KEEP_CHARS = 20
SPARSE_ABOUT_CHARS = 500
ABOUT_BUDGET, WEBSITE_BUDGET, SNIPPET_BUDGET, MAX_CATEGORY_NAMES = 2000, 1500, 800, 8
MIN_JUDGE_COVERAGE = 0.6
DEFAULT_ALPHA = 0.4
CANDIDATES = 50
MAX_LIMIT = 50

CHILD = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
TREE = T.ArrayType(T.StructType([T.StructField("l1_id", T.IntegerType()), T.StructField("l1_name", T.StringType()), T.StructField("children", T.ArrayType(CHILD))]))
SOURCE = T.StructType([T.StructField("location", T.StringType()), T.StructField("ebooth_url", T.StringType())])

#: The record of one show: strings default to empty, arrays to none.
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("company_name", "location", "ebooth_url", "about", "hq_location", "hq_country")]
    + [
        T.StructField("cat_l1_ids", T.ArrayType(T.IntegerType())),
        T.StructField("cat_l1_names", T.ArrayType(T.StringType())),
        T.StructField("cat_l2_ids", T.ArrayType(T.IntegerType())),
        T.StructField("cat_l2_names", T.ArrayType(T.StringType())),
        T.StructField("cat_tree", TREE),
        T.StructField("website", T.StringType()),
        T.StructField("website_scrape", T.StringType()),
    ]
)

REFINED = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("value_chain_position", "semiconductor_relevance", "summary")]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("capabilities", "technical_expertise", "end_markets")]
    + [T.StructField("regional_presence", T.MapType(T.StringType(), T.StringType()))]
)
