"""Facet counts that follow upserts: each entity's cells are state, and a new record withdraws the old cells as it adds its own."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.facets import facet_cells
from ..operators.filters import Selection
from ..sources.commits import Commits

_MARK = "\x1f"


def facet_deltas(records: DataFrame, selection: Selection) -> DataFrame:
    """(dim, value, delta) from a stream of records (id, _seq, _deleted and the catalogue's columns).

    State is an entity's cells and the ordinal of the record they came from. Of an entity's records in a batch the one with the highest
    ordinal counts, and none that is older than the state; a deleted one has no cells. Cells that didn't change give nothing.
    """
    cell = F.transform(facet_cells(selection), lambda c: F.concat(c["dim"], F.lit(_MARK), c["value"]))
    rows = records.select("id", F.col("_seq").cast("long").alias("_seq"), F.when(F.col("_deleted"), F.array().cast("array<string>")).otherwise(cell).alias("cells"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, cells = state.get if state.exists else (None, [])
        old, new = Counter(cells), None
        for f in frames:
            for s, c in zip(f["_seq"], f["cells"], strict=True):
                if seq is None or s >= seq:
                    seq, new = int(s), list(c)
        if new is None:
            return
        state.update((seq, new))
        change = Counter(new)
        change.subtract(old)
        rows = [(*k.split(_MARK, 1), n) for k, n in change.items() if n]
        yield pd.DataFrame(rows, columns=["dim", "value", "delta"])

    return rows.groupBy("id").applyInPandasWithState(update, "dim string, value string, delta long", "seq long, cells array<string>", "append", GroupStateTimeout.NoTimeout)


class LiveFacets:
    """Counts (dim, value, n) of one selection below path. Each batch makes a new table of counts and commits it with the batch's number,
    so a batch that is repeated after a failure counts once, and readers see the counts of whole batches."""

    def __init__(self, spark: SparkSession, path: str, selection: Selection = Selection()):
        self.spark, self.path, self.selection = spark, path, selection
        self.commits = Commits(spark, f"{path}/counts")

    def counts(self) -> DataFrame:
        """(dim, value, n) after the last batch; cells without entities aren't there."""
        folder = self.commits.last()[1].get("folder")
        return self.spark.read.parquet(folder) if folder else self.spark.createDataFrame([], "dim string, value string, n long")

    def _fold(self, deltas: DataFrame, batch: int) -> None:
        number, last = self.commits.last()
        if last.get("batch", -1) >= batch:
            return
        both = self.counts().unionByName(deltas.withColumnRenamed("delta", "n"))
        folder = self.commits.folder("counts")
        both.groupBy("dim", "value").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(folder)
        self.commits.add(number + 1, {"folder": folder, "batch": batch, "before": last.get("folder")})
        if last.get("before"):
            self.commits.remove(last["before"])

    def follow(self, folder: str, schema: T.StructType) -> StreamingQuery:
        """Reads all new Parquet files of folder once and brings the counts up to date; run it again for what comes later."""
        deltas = facet_deltas(self.spark.readStream.schema(schema).parquet(folder), self.selection)
        stream = deltas.writeStream.outputMode("append").foreachBatch(self._fold)
        return stream.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
