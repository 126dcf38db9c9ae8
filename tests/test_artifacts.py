"""Artifacts that are reused, repaired and rebuilt, and caches that lost bytes."""

import json
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hyperweave.plans import artifacts
from hyperweave.streaming import salvage


def counted(path, width=4):
    """An encoder that notes in a file every text that it sees."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        with open(path, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return texts.map(lambda t: [float(len(t))] * width)

    return encode


def seen(path):
    return sorted(path.read_text().split("\n")[:-1]) if path.exists() else []


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id string, content string")


def test_artifacts_encode_what_changed(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "kb")
    build = lambda rows, encoder="e1", width=4: artifacts.build_artifact(corpus(spark, rows), counted(str(log), width), root, "entities", encoder)
    rows = [(f"i{k}", f"text {k}") for k in range(20)] + [("twin", "text 1"), ("null", None)]
    told = build(rows)
    assert (told["decision"], told["n"], told["encoded"], told["dimension"]) == ("rebuild", 22, 22, 4) and len(seen(log)) == 22
    assert build(rows[::-1])["decision"] == "reuse" and len(seen(log)) == 22
    rows[3] = ("i3", "changed")
    told = build(rows)
    assert (told["decision"], told["encoded"]) == ("repair", 1) and len(seen(log)) == 23 and "changed" in seen(log)
    got = {r.id: (r.content, list(r.embedding)) for r in artifacts.read_artifact(spark, root, "entities").collect()}
    assert got == {i: (t or "", [float(len(t or ""))] * 4) for i, t in rows}
    assert build(rows, "e2")["decision"] == "rebuild" and len(seen(log)) == 45
    known = artifacts.manifest(spark, root, "entities")
    with pytest.raises(ValueError, match="duplicate ids"):
        build([*rows, rows[0]], "e2")
    assert artifacts.manifest(spark, root, "entities") == known


def test_damaged_vectors_are_not_reused(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "kb")
    rows = [(f"i{k}", f"text {k}") for k in range(5)]
    artifacts.build_artifact(corpus(spark, rows), counted(str(log)), root, "x", "e")
    corpus(spark, rows[:3]).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).write.mode("overwrite").parquet(f"{root}/x/v0/vectors")
    told = artifacts.build_artifact(corpus(spark, rows), counted(str(log)), root, "x", "e")
    assert (told["decision"], told["encoded"]) == ("repair", 5)
    assert artifacts.build_artifact(corpus(spark, rows), counted(str(log)), root, "x", "e")["decision"] == "reuse"


def test_build_of_a_base(spark, tmp_path):
    log, root = tmp_path / "log", str(tmp_path / "kb")
    docs = spark.createDataFrame([(1, "Alpha meets Beta in Gamma. Delta stays."), (2, "Epsilon writes to Zeta.")], "i int, text string")
    build = lambda d: {r.artifact: (r.decision, r.encoded) for r in artifacts.build_base(d, "text", counted(str(log)), root, "e").collect()}
    first = build(docs)
    assert {d for d, _ in first.values()} == {"rebuild"} and len(seen(log)) == sum(n for _, n in first.values())
    before = len(seen(log))
    assert set(build(docs).values()) == {("reuse", 0)} and len(seen(log)) == before
    again = build(docs.withColumn("text", F.when(F.col("i") == 2, "Epsilon writes to Eta.").otherwise(F.col("text"))))
    assert {d for d, _ in again.values()} == {"repair"} and 0 < len(seen(log)) - before < before


# caches


def line(row):
    text = json.dumps(row, separators=(",", ":"))
    return f"{zlib.crc32(text.encode()):08x}\t{text}\n"


ROWS = [{"query_key": f"key {k}", "original": f"Key\t{k}é", "result": "deadbeef" * (k + 1), "created": k, "updated": k, "hit_count": k} for k in range(5)]


def test_a_tear_costs_the_row_that_it_hits(spark, tmp_path):
    """The file cut at every byte, another writer's row behind the cut; and a byte changed everywhere."""
    each, data = [line(r).encode() for r in ROWS], b"".join(line(r).encode() for r in ROWS)
    ends = [sum(map(len, each[: k + 1])) for k in range(5)]
    after, cases = line({**ROWS[0], "query_key": "after"}).encode(), {}
    for cut in range(len(data) + 1):
        whole = {f"key {k}" for k, e in enumerate(ends) if e - 1 <= cut}  # a lost line break costs nothing
        cases[f"cut {cut}"] = (data[:cut] + after, whole | {"after"})
    for at in range(0, len(data), 3):
        hit = next(k for k, e in enumerate(ends) if at < e)
        cases[f"byte {at}"] = (data[:at] + b"#" + data[at + 1 :], {f"key {k}" for k in range(5)} - ({f"key {hit}"} if at != [0, *ends][hit] + 8 else set()))  # the tab itself is not summed
    rows = [(name, part) for name, (content, _) in cases.items() for part in content.decode("utf-8", "replace").split("\n")]
    got = {}
    for r in salvage.salvaged(spark.createDataFrame(rows, "name string, value string")).collect():
        got.setdefault(r["name"], set()).add(r.query_key)
    for name, (_, want) in cases.items():
        assert got.get(name, set()) == want, name


def test_newest_wins_and_rebuild(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = lambda rows: spark.createDataFrame([tuple(r.values()) for r in rows], salvage.ROW)
    salvage.append(df(ROWS), path)
    salvage.append(df([{**ROWS[1], "result": "new", "updated": 9, "hit_count": 0}]), path)
    (tmp_path / "cache" / "torn.txt").write_text(line(ROWS[0])[:-20] + line({**ROWS[0], "query_key": "late"}) + "\x00garbage\n" + "0" * 8 + "\t{}\n")
    told = salvage.rebuild(spark, path, str(tmp_path / "new"))
    assert told["rows"] == 7 and told["keys"] == 6
    got = {r.query_key: r.asDict() for r in salvage.read_cache(spark, str(tmp_path / "new")).collect()}
    assert got["key 1"] == {**ROWS[1], "result": "new", "updated": 9, "hit_count": 1} and got["late"]["original"] == "Key\t0é"
    assert {r.query_key for r in salvage.read_cache(spark, path).collect()} == set(got)
