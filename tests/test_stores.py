"""Stores as data sources, on SQLite: ranges, pushed filters, merges, and what failed writes leave."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from hyperweave.sources import stores


def save(df, path, merge="insert", mode="append"):
    df.write.format("kv_store").options(path=path, table="kv", merge=merge).mode(mode).save()


def held(path):
    with sqlite3.connect(path) as c:
        assert [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE name LIKE 'staged%'")] == []
        return dict(c.execute("SELECT id, value FROM kv"))


@pytest.fixture()
def path(spark, tmp_path):
    stores.register(spark)
    return str(tmp_path / "store.db")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in rows], "id string, value string").repartition(parts)


def test_round_trip_and_filters(spark, path):
    rows = [(f"k{n:03}", {"n": n}) for n in range(200)] + [("a'b", {"x": "é"})]
    save(table(spark, rows), path)
    read = lambda n: spark.read.format("kv_store").options(path=path, table="kv", partitions=n).load()
    for n in (1, 7, 500):
        assert {(r.id, r.value) for r in read(n).collect()} == {(k, json.dumps(v)) for k, v in rows}
    assert read(4).rdd.getNumPartitions() == 4
    got = read(4).where("id >= 'k010' AND id < 'k020' AND value LIKE '%1%'")
    assert {r.id for r in got.collect()} == {f"k{n:03}" for n in range(10, 20)}
    assert [r.id for r in read(4).where(F.col("id").isin("a'b", "none")).collect()] == ["a'b"] and read(4).where("id = 'k007'").count() == 1


def test_filters_reach_the_query(path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    reader = stores._Reader({"path": path, "table": "kv"})
    rest = list(reader.pushFilters([EqualTo(("id",), "a"), In(("id",), ("b", "c")), GreaterThan(("value",), "x"), StringContains(("id",), "d")]))
    assert reader.where == [("id = ?", ["a"]), ("id IN (?, ?)", ["b", "c"])] and len(rest) == 2


def test_merges(spark, path):
    save(table(spark, [("a", {"x": 1, "y": 1}), ("b", {"x": 1})]), path)
    save(table(spark, [("a", {"x": 2}), ("c", {"x": 2}), ("c", {"x": 3})]), path, "insert")
    assert held(path) == {"a": '{"x": 1, "y": 1}', "b": '{"x": 1}', "c": '{"x": 2}'}
    save(table(spark, [("b", {"x": 5}), ("b", {"x": 6})]), path, "overwrite")
    assert held(path)["b"] == '{"x": 6}'
    save(table(spark, [("a", {"x": 7}), ("a", {"z": 8}), ("d", {"w": 1}), ("c", "no json")]), path, "fields")
    assert held(path) == {"a": '{"x": 7, "y": 1, "z": 8}', "b": '{"x": 6}', "c": "no json", "d": '{"w": 1}'}
    save(table(spark, [("e", {})]), path, mode="overwrite")
    assert held(path) == {"e": "{}"}
    save(table(spark, []), path)
    assert held(path) == {"e": "{}"}


def test_failed_writes_leave_nothing(spark, path):
    save(table(spark, [("a", {"x": 1})]), path)
    bad = table(spark, [(f"k{n}", {"n": n}) for n in range(50)]).unionByName(spark.createDataFrame([(None, "{}")], "id string, value string"))
    with pytest.raises(Exception, match="an id is null"):
        save(bad, path, "overwrite")
    with sqlite3.connect(path) as c:
        assert dict(c.execute("SELECT id, value FROM kv")) == {"a": '{"x": 1}'}
    with pytest.raises(Exception, match="merge is one of"):
        save(bad, path, "other")
    with pytest.raises(Exception, match="no table's name"):
        spark.read.format("kv_store").options(path=path, table="kv; DROP").load().count()


def test_staging_of_lost_attempts_is_never_merged(path):
    """A task that ran twice: only the attempt whose message reaches the commit counts."""
    writer = stores._Writer({"path": path, "table": "kv"}, False)
    lost, taken = writer.write(iter([("a", "1"), ("b", "1")])), writer.write(iter([("a", "1"), ("b", "1")]))
    writer.commit([taken, None, writer.write(iter([]))])
    with sqlite3.connect(path) as c:
        assert dict(c.execute("SELECT id, value FROM kv")) == {"a": "1", "b": "1"}
    writer.abort([lost, None])
    assert held(path) == {"a": "1", "b": "1"}


def test_other_dialects():
    assert "INSERT IGNORE" in stores.STORES["tidb"].merge("insert", "t", "s")[0] and "ON DUPLICATE KEY UPDATE" in stores.STORES["mysql"].merge("fields", "t", "s")[0]
    sql = stores.STORES["oracle"].merge("overwrite", "t", "s")[0]
    assert sql.startswith("MERGE INTO t") and "WHEN MATCHED" in sql and "WHEN MATCHED THEN" not in stores.STORES["oracle"].merge("insert", "t", "s")[0]
