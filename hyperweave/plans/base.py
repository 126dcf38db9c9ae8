"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def made(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return made


def orders_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational hypergraph: orders are hyperedges, parts entities, quantities weights."""
    lines = read_table(spark, sf_dir, "lineitem")
    rows = spread(lines.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("hyperedge"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity"), "l_quantity"), "hyperedge", of=lines)
    return rows.groupBy("hyperedge", "entity").agg(F.sum("l_quantity").alias("weight"))


#: The same graph in SQL.
GRAPH = "inc AS (SELECT 'o' || l_orderkey AS hyperedge, 'p' || l_partkey AS entity, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"
SYM = "sym AS (SELECT hyperedge AS src, entity AS dst, weight FROM inc UNION ALL SELECT entity, hyperedge, weight FROM inc)"
