"""Catalogue tables, parameterised SQL, saved batches, vector indexes and metric sinks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectors import check_index

#: Logical tables of a workspace.
TABLES = {
    "doc_full": "workspace STRING, id STRING, content STRING, meta STRING, createtime TIMESTAMP, updatetime TIMESTAMP",
    "doc_chunks": "workspace STRING, id STRING, full_doc_id STRING, status STRING, chunk_order_index INT, tokens INT, content STRING, content_vector ARRAY<FLOAT>, createtime TIMESTAMP, updatetime TIMESTAMP",
    "graph_nodes": "workspace STRING, name STRING, entity_type STRING, description STRING, source_chunk_id STRING, content STRING, content_vector ARRAY<FLOAT>, createtime TIMESTAMP, updatetime TIMESTAMP",
    "graph_edges": "workspace STRING, source_name STRING, target_name STRING, weight DOUBLE, keywords STRING, description STRING, source_chunk_id STRING, content STRING, content_vector ARRAY<FLOAT>, createtime TIMESTAMP, updatetime TIMESTAMP",
    "llm_cache": "mode STRING, args_hash STRING, prompt STRING, response STRING, embedding ARRAY<SMALLINT>, low DOUBLE, high DOUBLE, createtime TIMESTAMP",
}


def bootstrap(spark: SparkSession, prefix: str = "") -> list[str]:
    """Creates the tables that are not there; returns their names."""
    made = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(prefix + name):
            part = " PARTITIONED BY (workspace)" if columns.startswith("workspace") else ""
            spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet{part}")
            made.append(prefix + name)
    return made


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Parameterised SQL (:name); several rows or none."""
    return spark.sql(sql, args=args)


def query_one(spark: SparkSession, sql: str, **args) -> dict | None:
    row = query(spark, sql, **args).first()
    return row.asDict() if row else None


def save_batch(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_index(vectors: DataFrame, path: str, meta: dict | None = None, key: str = "id", vector: str = "embedding") -> dict:
    """A checked vector index: Parquet rows and a metadata row. Empty, repeated or ragged input is an error."""
    found = check_index(vectors, key, vector).first()
    if found.blockers:
        raise ValueError(", ".join(found.blockers))
    vectors.select(key, vector).write.mode("overwrite").parquet(f"{path}/vectors")
    info = {"count": found.n, "dimension": found.high} | (meta or {})
    vectors.sparkSession.createDataFrame([(json.dumps(info, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return info


def load_index(spark: SparkSession, path: str, count: int | None = None) -> tuple[DataFrame, list[str]]:
    """The vectors, and what keeps them from being served: rows against the metadata and the store's count."""
    info = json.loads(spark.read.text(f"{path}/meta").first().value)
    vectors = spark.read.parquet(f"{path}/vectors")
    row = check_index(vectors, vectors.columns[0], vectors.columns[1], info["dimension"]).first()
    blockers = list(row.blockers)
    if row.n != info["count"]:
        blockers.append("metadata count differs")
    if count is not None and row.n != count:
        blockers.append("store count differs")
    return vectors, blockers


def encode_upsert(store: DataFrame, rows: DataFrame, encode: Callable, key: str = "id", text: str = "content") -> DataFrame:
    """A vector store after an upsert: new rows are encoded and beat stored ones."""
    new = rows.dropDuplicates([key]).select(key, encode(F.col(text)).alias("embedding"))
    return store.join(new.select(key), key, "left_anti").select(key, "embedding").unionByName(new)


def log_metrics(step: int, metrics: DataFrame, sinks: list[Callable[[int, dict], None]]) -> None:
    """One row of metrics to every sink."""
    row = metrics.first().asDict()
    for sink in sinks:
        sink(step, row)


def by_field(df: DataFrame, *paths: str) -> DataFrame:
    """Nested fields as columns named after their last part."""
    return df.select(*(F.col(p).alias(p.rpartition(".")[2]) for p in paths))
