"""Key-value stores behind SQL databases, as Spark data sources: plug-ins by name, filters pushed down, merges in two phases.

    register(spark)
    spark.read.format("kv_store").options(store="sqlite", path=..., table="chunks").load().where("id = 'a'")
    df.write.format("kv_store").options(store="sqlite", path=..., table="chunks", merge="insert").mode("append").save()

A row is (id string, value string), the value a JSON document. Reading is cut into ranges of ids at the table's own
quantiles; equalities, comparisons and IN on the id go into each range's query. Writing: every task attempt fills a staging table
of its own; the driver's commit merges the staging tables of successful attempts in one transaction and drops them, and an
abort drops what it knows of, so a retried task or a failed job leaves the store as it was. No row passes the driver.

merge: "insert" keeps what is there (of new rows that share an id, the smallest value), "overwrite" replaces it (the
greatest), "fields" lays the new document's top-level fields over the old one's (in the order of the new values).

Stores are plug-ins: `STORES` has them by name, each a Store with a connection and its dialect's statements. SQLite is
complete; the statements for MySQL-like (TiDB) and Oracle databases are made by the same plug-in interface and need a
driver of theirs on the executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..session import ship

MERGES = ("insert", "overwrite", "fields")
ROWS = 500


def _name(x: str) -> str:
    if not x.replace("_", "").isalnum():
        raise ValueError(f"{x!r} is no table's name")
    return x


class Store:
    """A database: connect(options) -> a DB-API connection, and its dialect."""

    mark = "?"

    def connect(self, options: dict):
        raise NotImplementedError

    def create(self, table: str) -> str:
        return f"CREATE TABLE IF NOT EXISTS {table} (id VARCHAR(512) PRIMARY KEY, value TEXT)"

    def stage(self, table: str) -> str:
        return f"CREATE TABLE {table} (id VARCHAR(512), value TEXT)"

    def drop(self, table: str) -> str:
        return f"DROP TABLE IF EXISTS {table}"

    def merge(self, kind: str, table: str, staged: str) -> list[str]:
        """Statements that merge one staging table, whose ids are unique, into the store's table."""
        raise NotImplementedError


class Sqlite(Store):
    def connect(self, options: dict):
        import sqlite3

        held = sqlite3.connect(options["path"], timeout=120, isolation_level=None)
        # fields of an object over another's; one that is not JSON replaces the old value
        held.create_function("lay_over", 2, _laid_over, deterministic=True)
        return held

    def merge(self, kind: str, table: str, staged: str) -> list[str]:
        clash = {"insert": "DO NOTHING", "overwrite": "DO UPDATE SET value = excluded.value", "fields": f"DO UPDATE SET value = lay_over({table}.value, excluded.value)"}[kind]
        return [f"INSERT INTO {table} (id, value) SELECT id, value FROM {staged} WHERE true ON CONFLICT (id) {clash}"]


class MySql(Store):
    """MySQL and what speaks like it (TiDB). connect: a DB-API connect function's module, by the option `driver`."""

    mark = "%s"

    def connect(self, options: dict):
        from importlib import import_module

        return import_module(options["driver"]).connect(**json.loads(options.get("connection", "{}")))

    def merge(self, kind: str, table: str, staged: str) -> list[str]:
        if kind == "insert":
            return [f"INSERT IGNORE INTO {table} (id, value) SELECT id, value FROM {staged}"]
        new = "VALUES(value)" if kind == "overwrite" else f"JSON_MERGE_PATCH({table}.value, VALUES(value))"
        return [f"INSERT INTO {table} (id, value) SELECT id, value FROM {staged} ON DUPLICATE KEY UPDATE value = {new}"]


class Oracle(MySql):
    mark = ":1"

    def create(self, table: str) -> str:
        return f"CREATE TABLE IF NOT EXISTS {table} (id VARCHAR2(512) PRIMARY KEY, value CLOB)"

    def stage(self, table: str) -> str:
        return f"CREATE TABLE {table} (id VARCHAR2(512), value CLOB)"

    def merge(self, kind: str, table: str, staged: str) -> list[str]:
        new = {"insert": "", "overwrite": " WHEN MATCHED THEN UPDATE SET t.value = s.value", "fields": " WHEN MATCHED THEN UPDATE SET t.value = JSON_MERGEPATCH(t.value, s.value)"}[kind]
        return [f"MERGE INTO {table} t USING {staged} s ON (t.id = s.id){new} WHEN NOT MATCHED THEN INSERT (id, value) VALUES (s.id, s.value)"]


STORES: dict[str, Store] = {"sqlite": Sqlite(), "mysql": MySql(), "tidb": MySql(), "oracle": Oracle()}


def _laid_over(old: str | None, new: str | None) -> str | None:
    try:
        a, b = json.loads(old or "null"), json.loads(new or "null")
    except ValueError:
        return new
    return json.dumps(a | b, sort_keys=True) if isinstance(a, dict) and isinstance(b, dict) else new


@dataclass
class _Range(InputPartition):
    low: str | None
    high: str | None


@dataclass
class _Staged(WriterCommitMessage):
    table: str | None


_SIGNS: dict[type, str] = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.store, self.table = dict(options), STORES[options.get("store", "sqlite")], _name(options["table"])
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _SIGNS and f.attribute == ("id",) and f.value is not None:
                self.where.append((f"id {_SIGNS[type(f)]} {self.store.mark}", [f.value]))
            elif isinstance(f, In) and f.attribute == ("id",) and f.value and None not in f.value:
                self.where.append((f"id IN ({', '.join([self.store.mark] * len(f.value))})", list(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Ranges of equal numbers of ids; only their borders come here."""
        parts = int(self.options.get("partitions", "8"))
        held = self.store.connect(self.options)
        try:
            at = held.cursor()
            at.execute(self.store.create(self.table))
            at.execute(f"SELECT min(id), n FROM (SELECT id, ntile({parts}) OVER (ORDER BY id) AS n FROM {self.table}) x GROUP BY n ORDER BY n")
            lows = [r[0] for r in at.fetchall()]
        finally:
            held.close()
        return [_Range(None if k == 0 else low, high) for k, (low, high) in enumerate(zip(lows, [*lows[1:], None]))] or [_Range(None, None)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        where = [*self.where]
        if partition.low is not None:
            where.append((f"id >= {self.store.mark}", [partition.low]))
        if partition.high is not None:
            where.append((f"id < {self.store.mark}", [partition.high]))
        held = self.store.connect(self.options)
        try:
            at = held.cursor()
            sql = f"SELECT id, value FROM {self.table}" + (" WHERE " + " AND ".join(w for w, _ in where) if where else "")
            at.execute(sql, [v for _, values in where for v in values])
            while rows := at.fetchmany(ROWS):
                yield from rows
        finally:
            held.close()


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.store, self.table = dict(options), STORES[options.get("store", "sqlite")], _name(options["table"])
        self.kind, self.overwrite = options.get("merge", "insert"), overwrite
        if self.kind not in MERGES:
            raise ValueError(f"merge is one of {', '.join(MERGES)}")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        staged = f"staged_{uuid.uuid4().hex}"
        held, some = self.store.connect(self.options), False
        try:
            at = held.cursor()
            at.execute(self.store.stage(staged))
            put = f"INSERT INTO {staged} (id, value) VALUES ({self.store.mark}, {self.store.mark if self.store.mark != ':1' else ':2'})"
            waiting = []
            at.execute("BEGIN")
            for row in rows:
                if row[0] is None:
                    raise ValueError("an id is null")
                waiting.append((row[0], row[1]))
                if len(waiting) == ROWS:
                    at.executemany(put, waiting)
                    waiting, some = [], True
            if waiting:
                at.executemany(put, waiting)
                some = True
            if not some:
                at.execute(self.store.drop(staged))
            at.execute("COMMIT")
        except BaseException:
            held.close()
            again = self.store.connect(self.options)
            again.cursor().execute(self.store.drop(staged))
            again.close()
            raise
        held.close()
        return _Staged(staged if some else None)

    def commit(self, messages: list) -> None:
        """One transaction: everything or nothing."""
        tables, whole = [m.table for m in messages if m and m.table], f"staged_{uuid.uuid4().hex}"
        held = self.store.connect(self.options)
        try:
            at = held.cursor()
            at.execute("BEGIN")
            at.execute(self.store.create(self.table))
            if self.overwrite:
                at.execute(f"DELETE FROM {self.table}")
            if tables:
                rows = " UNION ALL ".join(f"SELECT id, value FROM {t}" for t in tables)
                at.execute(self.store.stage(whole))
                if self.kind == "fields":  # rows of one id one after the other, smallest value first
                    at.execute(f"SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM ({rows}) x GROUP BY id) y")
                    for k in range(1, at.fetchone()[0] + 1):
                        at.execute(f"DELETE FROM {whole}")
                        at.execute(f"INSERT INTO {whole} SELECT id, value FROM (SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY value) AS k FROM ({rows}) x) y WHERE k = {k}")
                        for sql in self.store.merge("fields", self.table, whole):
                            at.execute(sql)
                else:
                    pick = "min" if self.kind == "insert" else "max"
                    at.execute(f"INSERT INTO {whole} SELECT id, {pick}(value) FROM ({rows}) x GROUP BY id")
                    for sql in self.store.merge(self.kind, self.table, whole):
                        at.execute(sql)
                for t in (*tables, whole):
                    at.execute(self.store.drop(t))
            at.execute("COMMIT")
        finally:
            held.close()

    def abort(self, messages: list) -> None:
        held = self.store.connect(self.options)
        try:
            for m in messages:
                if m and m.table:
                    held.cursor().execute(self.store.drop(m.table))
        finally:
            held.close()


class KeyValueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kv_store"

    def schema(self) -> str:
        return "id string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["id", "value"]:
            raise ValueError("a store takes rows of (id, value)")
        return _Writer(self.options, overwrite)


def register(spark: SparkSession, stores: dict[str, Store] | None = None) -> Callable:
    """Makes the source known to the session, with further plug-ins by name."""
    STORES.update(stores or {})
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyValueSource)
    return spark.read.format("kv_store").options
