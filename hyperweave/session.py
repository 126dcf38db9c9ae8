"""Session helpers: tables, the folder that all executors share, and settled tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="hyperweave-")) / "hyperweave.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task groups or sorts at once.
ROWS = 1 << 19


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """df dealt by the keys, so that what is grouped by them is grouped where it comes to lie and not in its input's splits
    before. There are as many parts as the session shuffles into, or more: one for each ROWS rows of the table `of`, so
    that a task's share does not grow with the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-of.count() // ROWS)) if of is not None else parts, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, as a URI. Only where that is unset (local tests) a temporary folder is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not found and not held:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="hyperweave-")
    found = found or held
    if not held:
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read from there: a lost executor or a retried task does not run its lineage
    again. The package goes to the executors first, wherever df was read."""
    ship(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
