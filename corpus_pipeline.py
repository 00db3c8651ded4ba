"""The corpus pipeline: STAGES of (name, function), each a function of (spark, docs, sf_dir).

All stages take whole tables of documents. A null or empty text has no words and no tokens; an empty table gives an empty table; a
null doc_id is a key like others, and repeated ids are rows of their own, told apart by their texts; further columns are carried
along, whatever their names. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cataloom.llm import queries as q
from cataloom.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the learned rules reject go; so do those without words. Rows that repeat get one verdict.
    Without labels only the base limits hold."""
    from cataloom.llm.quality_rules import fit_rules, kept

    return kept(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies stays, whatever the ids: the one with the lowest id, null being lowest, and
    of its texts under that id the one with the lowest hash. Texts without words are one class."""
    from cataloom.llm.minhash_dedup import one_of_each

    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more occurs in benchmark items go; without items, or without words, none does."""
    from cataloom.llm.decontaminate import contamination

    bad = contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("k"), "r").distinct()
    r = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["k"]) & (r == bad["r"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, by their source's target weight. A null source is a source; rows with one id get one number."""
    from cataloom.llm.mixing import poisson_mix

    return poisson_mix(docs, q.MIX_WEIGHTS, seed=q.MIX_SEED).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in ascending doc_id order and read back: doc_id, start, n_tokens, ids_crc32. A null id comes first; of
    rows with one id the order is that of their texts."""
    from cataloom.llm.token_store import token_table

    return token_table(docs, q.tokenizer_path(), end_id=q.END_ID).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Neither the trained rules nor the tokenizer can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
