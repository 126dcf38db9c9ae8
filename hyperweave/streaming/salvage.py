"""A cache kept as a log of checked lines, and what can be saved from torn ones.

A line is the CRC-32 of a row's JSON in eight hexadecimal digits, a tab, and the JSON, which itself never holds a tab or a
line break. Writers append files of lines; a writer that dies, or a store that loses bytes, leaves torn lines. A reader
finds the beginnings of rows by digits and tab, wherever they stand in a line, and takes what its sum confirms; so
a tear costs the row that it hits and no other. All of it is column functions: files are read in splits by Spark.

Contract. Of rows of one key the newest counts (ties: the greater result), hits are the most that any of them has. Rows
without a key, and JSON that lacks the columns, are dropped. Empty files give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "query_key string, original string, result string, created long, updated long, hit_count long"


def _sum(json: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(json.cast("binary")))), 8, "0")


def lines(rows: DataFrame) -> DataFrame:
    """(value): the rows as checked lines."""
    json = F.to_json(F.struct(*(c.split()[0] for c in ROW.split(", "))))
    return rows.select(json.alias("j")).select(F.concat(_sum(F.col("j")), F.lit("\t"), "j").alias("value"))


def append(rows: DataFrame, path: str) -> None:
    lines(rows).write.mode("append").text(path)


def salvaged(text: DataFrame) -> DataFrame:
    """(ROW columns, and others of text): every row that some beginning in a line holds whole. text: (value, ...)."""
    pieces = F.split("value", r"(?=[0-9a-f]{8}\t)")
    held = text.withColumn("__piece", F.explode(pieces)).where(F.length("__piece") > 9)
    json = F.substring("__piece", 10, 1 << 30)
    whole = held.where(F.substring("__piece", 1, 8) == _sum(json)).withColumn("__row", F.from_json(json, ROW))
    others = [c for c in text.columns if c != "value"]
    return whole.select(*others, "__row.*").where(F.col("query_key").isNotNull())


def newest(rows: DataFrame) -> DataFrame:
    """One row for each key."""
    last = F.max(F.struct("updated", "result", "original", "created"))
    found = rows.groupBy("query_key").agg(last.alias("x"), F.max("hit_count").alias("hit_count"))
    return found.select("query_key", "x.original", "x.result", "x.created", "x.updated", "hit_count")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return newest(salvaged(spark.read.text(path)))


def rebuild(spark: SparkSession, path: str, into: str) -> dict:
    """Writes the newest rows as a cache of their own beside the damaged one, which stays as it is; returns counts of lines,
    of rows saved, and of keys."""
    text = spark.read.text(path)
    rows = salvaged(text)
    lines(newest(rows)).write.mode("errorifexists").text(into)
    return {"lines": text.count(), "rows": rows.count(), "keys": spark.read.text(into).count()}
