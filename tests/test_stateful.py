"""The stateful stream of edits against the fold of a batch."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hyperweave.streaming import edits as E
from hyperweave.streaming import stateful

TASKS = "seq long, update_type string, working_dir string, content string, new_content string"


def random_tasks(rng, n, dirs=2):
    words = ["alpha", "beta", "gamma delta", "epsilon zeta", "content of nation", "a long enough content"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(["", " x", " Y"])
    out = []
    for seq in range(1, n + 1):
        kind, t = rng.choice(["insert", "insert", "update", "delete"]), text()
        if kind != "insert" and rng.random() < 0.6:
            t = t[rng.randint(0, 3) : rng.randint(len(t) // 2, len(t))]  # a part of a content
        out.append((seq, kind, f"d{rng.randrange(dirs)}", t or "x", text() if kind == "update" else None))
    return out


def started(rng, n):
    return [(f"d{k % 2}", k + 1, f"content of nation {k} {rng.choice('xyz')}", float(k % 4), None, False, 0) for k in range(n)]


def run(spark, tmp_path, batches, size, seconds=None):
    """The stream's rows; each of the batches is a file, and a micro-batch."""
    for k, df in enumerate(batches):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.01)
    schema = batches[0].schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return E.drain(stateful.stream_tasks(stream, size, seconds), mode="update")


def by_fold(spark, state, tasks):
    """State and results when every task is a batch of its own, in the order of seq."""
    each = spark.createDataFrame(tasks, TASKS).withColumns({"batch": F.col("seq"), "place": F.lit(1)})
    held = spark.createDataFrame(state, E.STATE)
    return {tuple(r) for r in E.apply_batch(held, each).collect()}, {(r.seq, r.status, r.id) for r in E.task_results(held, each).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_equals_fold(spark, tmp_path, seed):
    rng = random.Random(seed)
    state, tasks = started(rng, 12), random_tasks(rng, 120)
    want_state, want = by_fold(spark, state, tasks)
    base = spark.createDataFrame(state, E.STATE)
    loads = stateful.load_rows(base)
    parts = [loads] + [spark.createDataFrame(tasks[a : a + 40], TASKS).withColumns({"id": F.lit(None).cast("long"), "weight": F.lit(None).cast("double"), "original_weight": F.lit(None).cast("double"), "deleted": F.lit(None).cast("boolean")}).select(*loads.columns) for a in (0, 40, 80)]
    out = run(spark, tmp_path, parts, size=1)
    got = {(r.seq, r.status, r.id) for r in out.where("kind = 'result'").collect()}
    assert got == want and len({s for _, s, _ in got}) == 3
    assert {tuple(r) for r in stateful.latest(base, out).collect()} == want_state
    assert out.where("kind = 'flush'").agg(F.max("flush")).first()[0] == 3


def test_flush_by_timer(spark, tmp_path):
    rows = [(1, "insert", "d", "one content", None), (2, "insert", "e", "another content", None)]
    spark.createDataFrame(rows, TASKS).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(TASKS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    query = stateful.stream_tasks(stream, 50, 0.5).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, n: seen.extend(df.collect())).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and sum(r.kind == "flush" for r in seen) < 2:
            time.sleep(0.2)
    finally:
        query.stop()
    assert {(r.working_dir, r.seq, r.status) for r in seen if r.kind == "result"} == {("d", 1, "succeeded"), ("e", 2, "succeeded")}
    assert {(r.working_dir, r.id, r.content, r.flush) for r in seen if r.kind == "flush"} == {("d", 1, "one content", 1), ("e", 1, "another content", 1)}


def test_what_fails(spark, tmp_path):
    rows = [(1, "insert", "d", " ", None), (2, "other", "d", "x", None), (3, "update", "d", "x", None), (4, "delete", "d", "absent content", None), (5, "insert", "d", None, None), (6, "insert", "d", "Twice", None), (7, "insert", "d", " twice ", None)]
    out = run(spark, tmp_path, [spark.createDataFrame(rows, TASKS)], size=1)
    assert {r.seq: r.status for r in out.where("kind = 'result'").collect()} == {1: "failed", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "succeeded", 7: "skipped"}


def test_parts_share_a_gram_with_what_contains_them():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab cdé") for _ in range(rng.randint(10, 60)))
        a = rng.randint(0, len(text) - 10)
        part = text[a : rng.randint(a + 10, len(text))]
        assert grams_of(part) <= grams_of(text) and grams_of(part)
    assert not grams_of("short")


def grams_of(x):
    return stateful.grams(x)


def test_untouched_records_stay_out_of_the_fold(spark):
    state = spark.createDataFrame([("d", k, f"content number {k} of many", 1.0, None, False, 0) for k in range(200)] + [("e", 1, "elsewhere", 1.0, None, False, 0)], E.STATE)
    tasks = spark.createDataFrame([(1, "delete", "d", "Content number 7  of many", None), (2, "update", "d", "number 12 of many", "new"), (3, "insert", "d", "fresh", None)], TASKS)
    assert sorted(r.id for r in E.reached(state, tasks).collect()) == [7, 12]
    after = E.apply_all(state, tasks)
    assert after.count() == 202 and after.where("content = 'fresh'").first().id == 200 and after.where("deleted").first().id == 7
