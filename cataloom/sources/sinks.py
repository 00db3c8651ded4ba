"""Writers. Folders of part files are the rule; single files are for small exports only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that an export as a single file may have; more are written as a folder.
EXPORT_ROWS = 100_000


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def export_json_array(df: DataFrame, path: str, indent: int = 2) -> None:
    """One file with a JSON array, letters as they are, for tables of at most EXPORT_ROWS rows."""
    rows = df.limit(EXPORT_ROWS + 1).toJSON().collect() if not df.sparkSession.conf.get("spark.remote", None) else [json.dumps(r.asDict(True)) for r in df.limit(EXPORT_ROWS + 1).collect()]
    if len(rows) > EXPORT_ROWS:
        raise ValueError(f"more than {EXPORT_ROWS} rows; write_json_lines writes any number")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, ensure_ascii=False, indent=indent)


def flat_cells(df: DataFrame, sep: str = " | ") -> DataFrame:
    """Lists as one text, structs as JSON, for CSV."""

    def flat(c: str, kind: str):
        if kind in ("array<string>", "array<int>", "array<bigint>"):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)
        return F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c)

    return df.select(*(flat(c, kind) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, sep: str = " | ", mode: str = "overwrite", bom: bool = False) -> None:
    """CSV with header, lists joined by sep; columns chooses some. With bom each file begins with a byte order mark."""
    flat = flat_cells(df.select(*columns) if columns else df, sep)
    if bom:
        flat = flat.withColumnRenamed(flat.columns[0], "\ufeff" + flat.columns[0])
    flat.write.mode(mode).option("quoteAll", False).option("escape", '"').csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines."""
    df.write.mode("append").json(path)


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def write_index(catalogue: DataFrame, vectors: DataFrame, postings: DataFrame, path: str) -> None:
    """The three tables of the index; postings are clustered by term so that a query reads few files."""
    catalogue.write.mode("overwrite").parquet(f"{path}/catalogue")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    postings.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
