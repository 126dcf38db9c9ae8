"""Versioned tables: edits are staged, checked, and only then become what is read."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables below one folder, each version a folder of its own, and an append-only log of which one is current.

    The log is a text table written through Spark, so it can lie in any store that Spark reads. A failed edit leaves the
    current version as it was; restoring writes a log entry that points back.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entries(self) -> list[dict]:
        try:
            rows = self.spark.read.text(f"{self.root}/_log").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((json.loads(r.value) for r in rows), key=lambda e: e["entry"])

    def current(self) -> int | None:
        found = self._entries()
        return found[-1]["version"] if found else None

    def read(self, table: str, version: int | None = None) -> DataFrame:
        version = self.current() if version is None else version
        if version is None:
            raise ValueError("no version yet")
        return self.spark.read.parquet(f"{self.root}/v{version}/{table}")

    def _point(self, version: int, note: str) -> None:
        entry = {"entry": len(self._entries()), "version": version, "note": note, "at": time.time()}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/_log")

    def commit(self, tables: dict[str, DataFrame], check: Callable[[Versions, int], list[str]] | None = None, note: str = "") -> int:
        """Writes a new version and, if the check finds no blockers in it, makes it current."""
        known = [e["version"] for e in self._entries()]
        version = max(known, default=-1) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        if check and (blockers := check(self, version)):
            raise ValueError(f"version {version} is not served: {', '.join(blockers)}")
        self._point(version, note)
        return version

    def restore(self, version: int) -> None:
        if version not in {e["version"] for e in self._entries()}:
            raise ValueError(f"version {version} was never current")
        self._point(version, "restored")

    def changed_since(self, entry: int) -> bool:
        """Whether a reader that last saw this log entry must reload."""
        found = self._entries()
        return bool(found) and found[-1]["entry"] > entry
