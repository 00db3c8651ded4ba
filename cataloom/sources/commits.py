"""Tables that change by commits: data goes to new folders, and one small file tells which folders count.

A reader sees the last commit that is whole, a writer adds its commit with the next number, and the file system's refusal to create a
file twice decides between two writers. What a writer that died has left behind is in no commit and is never read.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Commits:
    """The commits of one table below path, numbered from 1 on. A commit is a JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _read(self, path: Any) -> dict | None:
        stream = self._fs.open(path)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer died between creating and filling it
            return None

    def numbers(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def last(self) -> tuple[int, dict]:
        """The number of the last file, whole or not, and the last whole commit; (0, {}) if there is none."""
        numbers = self.numbers()
        for n in reversed(numbers):
            found = self._read(self._hadoop(f"{self.path}/_commits/{n:012d}"))
            if found is not None:
                return numbers[-1], found
        return (numbers[-1] if numbers else 0), {}

    def add(self, number: int, commit: dict) -> bool:
        """Writes a commit; False if another has the number."""
        file = self._hadoop(f"{self.path}/_commits/{number:012d}")
        if self._fs.exists(file):
            return False
        try:
            out = self._fs.create(file, False)
        except Exception as e:  # noqa: BLE001  py4j wraps what the file system throws
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
        finally:
            out.close()
        return True

    def folder(self, name: str) -> str:
        """A new folder for data."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        self._fs.delete(self._hadoop(folder), True)
