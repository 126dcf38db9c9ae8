"""Helpers that the corpus operators share: tables, words, and files in the folder that all executors see."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import scratch, settled, ship  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word of the text queries: a run of ASCII letters (lower case), digits and anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte table with the same meaning on UTF-8: A-Z to lower case, separators to a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


#: Rows of an Arrow batch: documents are long, and a Python worker holds a batch as a whole.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the package goes to the executors, and Arrow batches are made smaller, unless their size was set."""
    found = session.read_table(spark, sf_dir, name)
    if spark.conf.get(BATCH, "10000") == "10000":  # Spark's own default; any other choice is left alone
        spark.conf.set(BATCH, ROWS)
    return found


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> pa.NativeFile:
    """An output stream, its folder made where the store has folders."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_ranges(uri: str) -> pa.NativeFile:
    """A random-access input of which single ranges are read."""
    store, path = filesystem(uri)
    return store.open_input_file(path)


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
