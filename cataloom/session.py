"""Sessions, and the library's own code on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch.
ARROW_ROWS, ARROW_BYTES = 4096, 16 << 20
_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once, so that Python functions of it can be loaded there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bounds the rows and bytes of an Arrow batch, and so the memory of a Python worker, for the session; lower settings stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        have = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b") or 0)
        if not 0 < have <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def local_session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cataloom")
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
