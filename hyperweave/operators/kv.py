"""Key-value stores as tables: reads, anti-joins, and the three upsert rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_keys(store: DataFrame, key: str = "id") -> DataFrame:
    return store.select(key)


def get_by_id(store: DataFrame, value: object, key: str = "id") -> DataFrame:
    return store.where(F.col(key) == value)


def get_by_ids(store: DataFrame, ids: DataFrame, key: str = "id", pos: str = "pos", fields: Sequence[str] | None = None) -> DataFrame:
    """Rows in the order of `pos`, with nulls for misses."""
    picked = store.select(key, *(fields or [c for c in store.columns if c != key]))
    return ids.join(picked, key, "left").orderBy(pos)


def missing_keys(ids: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().join(store.select(key), key, "left_anti")


def insert_if_absent(store: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The rows that a first-wins upsert adds; stored rows are never overwritten."""
    fresh = rows.join(store.select(key), key, "left_anti")
    if order is None:
        return fresh.dropDuplicates([key])
    return first_per_key(fresh, [key], [F.col(order)])


def upsert_first(store: DataFrame, rows: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    return store.unionByName(insert_if_absent(store, rows, key, order), allowMissingColumns=True)


def upsert_last(store: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row by `order` for each key; new rows beat stored ones."""
    both = store.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return first_per_key(both, [key], [F.desc("__new"), F.desc(order)]).drop("__new")


def merge_fields(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Field-wise update: a new row's non-null fields replace the stored ones, absent keys are added."""
    names = [c for c in store.columns if c != key]
    new = rows.select(key, *(F.col(c).alias(f"__{c}") for c in rows.columns if c != key))
    kept = [F.coalesce(f"__{c}", c).alias(c) if f"__{c}" in new.columns else F.col(c) for c in names]
    return store.join(new, key, "full").select(key, *kept)


def drop_all(store: DataFrame) -> DataFrame:
    return store.limit(0)


def first_per_key(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__r = 1").drop("__r")


def ordered_distinct(values: str, pos: str):
    """Aggregate: distinct values in the order of their first position."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(values).alias("v")))), lambda x: x["v"]))


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def set_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Distinct rows of after that are not in before."""
    return after.subtract(before)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()
