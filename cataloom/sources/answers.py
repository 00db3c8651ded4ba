"""A log of a model's answers that is added to by commits, repaired key by key, and compacted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import Commits

SCHEMA = "cache_key string, raw string, status string, attempt int"
#: Statuses of answers that needn't be asked for again.
GOOD = ("ok", "empty-input")
#: Folders of a log that are read together; more are compacted.
MOST_FOLDERS = 64


class AnswerLog:
    """Answers (cache_key, raw, status) below path, each with the number of its attempt."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    def rows(self) -> DataFrame:
        """All attempts of the last commit."""
        folders = self.commits.last()[1].get("folders", [])
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def read(self) -> DataFrame:
        """(cache_key, raw, status, attempt): of each key the last good attempt, or the last one if none is good."""
        order = F.struct(F.col("status").isin(*GOOD), "attempt", F.coalesce("raw", F.lit("")))
        return self.rows().groupBy("cache_key").agg(F.max_by(F.struct("raw", "status", "attempt"), order).alias("v")).select("cache_key", "v.*")

    def append(self, answers: DataFrame) -> None:
        """Adds answers (cache_key, raw, status), an attempt later than those that their keys have. They are written once, in a folder of
        their own, and count from the commit on; a writer that dies before leaves the log as it was."""
        have = self.rows().groupBy("cache_key").agg(F.max("attempt").alias("_had"))
        numbered = answers.select("cache_key", "raw", "status").join(have, "cache_key", "left").select("cache_key", "raw", "status", (F.coalesce("_had", F.lit(0)) + 1).cast("int").alias("attempt"))
        folder = self.commits.folder("answers")
        numbered.write.parquet(folder)
        self._commit(lambda folders: [*folders, folder])
        if len(self.commits.last()[1]["folders"]) > MOST_FOLDERS:
            self.compact()

    def _commit(self, change) -> None:
        while True:
            number, last = self.commits.last()
            if self.commits.add(number + 1, {"folders": change(last.get("folders", []))}):
                return

    def compact(self) -> None:
        """One folder with the rows of read() in place of those that were there; what others add meanwhile stays. The old folders go."""
        old = self.commits.last()[1].get("folders", [])
        if len(old) < 2:
            return
        folder = self.commits.folder("answers")
        self.read().write.parquet(folder)
        self._commit(lambda folders: [folder, *(f for f in folders if f not in old)])
        for f in old:
            self.commits.remove(f)

    def repaired(self, keys: Sequence[str] | DataFrame) -> DataFrame:
        """(cache_key) to ask again: those of keys that the log has, whatever their status."""
        wanted = keys if isinstance(keys, DataFrame) else self.spark.createDataFrame([(k,) for k in keys], "cache_key string")
        return self.read().join(wanted.select("cache_key").distinct(), "cache_key", "left_semi").select("cache_key")
