"""Edits of the hypergraph: the fold of a batch of tasks, and the same over a stream.

Tasks are (seq, update_type, working_dir, content, new_content). Insert adds a hyperedge that is not there. Update
finds one by content, deleted ones too, renames it, and brings a deleted one back at its original weight. Delete halves
the weight (0.05 if it was not positive), keeps the original weight of the first deletion, and leaves the record
searchable. A batch regroups its tasks by type, in the order in which the types first occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import query_key
from ..operators.partition import numbered
from ..session import scratch, settled

BATCH, RING = 50, 256
STATE = "working_dir string, id long, content string, weight double, original_weight double, deleted boolean, changed long"


def batched(tasks: DataFrame, seq: str = "seq", size: int = BATCH) -> DataFrame:
    """Tasks with their batch number and their place in it once regrouped by type."""
    tasks = numbered(tasks, seq, into="__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")
    first = F.min(seq).over(Window.partitionBy("batch", "update_type"))
    return tasks.withColumn("__first", first).withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("__first", seq))).drop("__first")


def soft_deleted(weight: Column, times: Column) -> Column:
    """A weight after so many soft deletions without an update between: only the first counts, since deleted records are skipped."""
    return F.when(times == 0, weight).when(weight > 0, weight / 2).otherwise(0.05)


def reached(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """The records, with their key `k`, that some lookup of the tasks can find: those of the same key, and, for updates
    and deletes of ten characters or more, those that contain it and are at most twice as long. No task can touch others,
    so only these need to meet in one place. Containment is an equi-join on the first ten characters, then verified."""
    s = state.withColumn("k", query_key("content"))
    asked = tasks.select("working_dir", query_key("content").alias("k"), (F.col("update_type") != "insert").alias("loose"))
    exact = s.join(asked.select("working_dir", "k").distinct(), ["working_dir", "k"], "left_semi").select("working_dir", "id")
    loose = asked.where("loose AND length(k) >= 10").select("working_dir", F.col("k").alias("t"), F.substring("k", 1, 10).alias("g")).distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("k") - 9), lambda i: F.col("k").substr(i, F.lit(10))))
    met = s.where("length(k) > 10").select("working_dir", "id", F.explode(grams).alias("g")).join(loose.select("working_dir", "g").distinct(), ["working_dir", "g"], "left_semi")
    near = met.join(loose, ["working_dir", "g"]).drop("g").distinct().join(s.select("working_dir", "id", "k"), ["working_dir", "id"])
    near = near.where(F.contains("k", F.col("t")) & (F.length("t") * 2 >= F.length("k"))).select("working_dir", "id")
    return s.join(exact.unionByName(near).distinct(), ["working_dir", "id"], "left_semi")


def _keyed(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks with the keys of their contents and the largest id of their directory."""
    top = state.groupBy("working_dir").agg(F.max("id").alias("top"))
    return tasks.withColumns({"k": query_key("content"), "new_k": query_key("new_content")}).join(top, "working_dir", "left")


def _fold(state: pd.DataFrame, tasks: pd.DataFrame) -> tuple[pd.DataFrame, list]:
    """State after the tasks in their order, and each task's result. state holds what reached() keeps; the tasks' `top`
    is the largest id of all."""
    rows = {int(r.id): dict(r._asdict()) for r in state.itertuples(index=False)}
    top = int(tasks["top"].fillna(0).max()) if len(tasks) else 0
    by = {}
    for i in sorted(rows):
        by.setdefault(rows[i]["k"], []).append(i)
    results = []

    def resolve(want: str, skip_deleted: bool) -> int | None:
        for i in by.get(want, []):
            if not (skip_deleted and rows[i]["deleted"]):
                return i
        best = None
        if len(want) >= 10:
            for i in sorted(rows):
                have = rows[i]["k"]
                if not (skip_deleted and rows[i]["deleted"]) and want in have and len(want) / len(have) >= 0.5:
                    if best is None or len(want) / len(have) > best[0]:
                        best = (len(want) / len(have), i)
        return best[1] if best else None

    for t in tasks.sort_values(["batch", "place"]).itertuples(index=False):
        if t.update_type == "insert":
            i = resolve(t.k, False) if by.get(t.k) else None
            if i is None:
                i = top = top + 1
                rows[i] = {"working_dir": t.working_dir, "id": i, "content": t.content, "weight": 1.0, "original_weight": None, "deleted": False, "changed": t.seq, "k": t.k}
                by.setdefault(t.k, []).append(i)
                results.append((t.seq, "succeeded", i))
            else:
                results.append((t.seq, "skipped", i))
            continue
        i = resolve(t.k, t.update_type == "delete")
        if i is None:
            results.append((t.seq, "failed", None))
            continue
        r = rows[i]
        if t.update_type == "update":
            by[r["k"]].remove(i)
            r["content"], r["k"] = t.new_content, t.new_k
            by.setdefault(t.new_k, []).append(i)
            by[t.new_k].sort()
            if r["deleted"]:
                w = r["original_weight"]
                r["weight"], r["original_weight"], r["deleted"] = (w if w is not None and w == w else r["weight"]), None, False
        else:
            w = r["weight"]
            if r["original_weight"] is None or r["original_weight"] != r["original_weight"]:
                r["original_weight"] = w
            r["weight"], r["deleted"] = (w / 2 if w > 0 else 0.05), True
        r["changed"] = t.seq
        results.append((t.seq, "succeeded", i))
    return pd.DataFrame(list(rows.values()), columns=list(state.columns)).drop(columns="k"), results


def apply_batch(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """The state of every working directory after its batches (with `batch` and `place`). Directories are independent;
    within one, a task sees what earlier ones did, so its tasks are folded in one place, with the records that they can
    reach; all other records, however many a directory has, stay where they are. Ids are unique in a directory."""

    def fold(key, held: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        out, _ = _fold(held, todo)
        return out

    mine = settled(reached(state, tasks))
    mine = mine.select(*(F.col(c).alias(c) for c in mine.columns))  # columns of their own, should the tasks come from the state
    folded = mine.groupBy("working_dir").cogroup(_keyed(state, tasks).groupBy("working_dir")).applyInPandas(fold, STATE)
    rest = state.join(mine.select("working_dir", "id"), ["working_dir", "id"], "left_anti")
    return rest.unionByName(folded)


def task_results(state: DataFrame, tasks: DataFrame) -> DataFrame:
    """(seq, status, id) of every task of a batch."""

    def fold(key, held: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(held, todo)[1], columns=["seq", "status", "id"])

    return reached(state, tasks).groupBy("working_dir").cogroup(_keyed(state, tasks).groupBy("working_dir")).applyInPandas(fold, "seq long, status string, id long")


def apply_all(state: DataFrame, tasks: DataFrame, size: int = BATCH) -> DataFrame:
    """All batches in their order. Batches are cut over all directories; each directory then folds its own tasks of all
    batches in one pass, since no task sees another directory."""
    return settled(apply_batch(state, batched(tasks, size=size)))


def mutation_log(tasks: DataFrame, seq: str, action: str, key: str, content: Column, active: Column) -> DataFrame:
    return tasks.select(F.col(seq).alias("seq"), F.col(key).alias("id"), F.col(action).alias("action"), content.alias("content"), active.alias("active"), F.lit(True).alias("searchable"))


def latest_state(log: DataFrame) -> DataFrame:
    """The newest mutation of every id."""
    return log.groupBy("id").agg(F.max_by(F.struct("action", "content", "active"), "seq").alias("x"), F.max("seq").alias("seq"), F.count("*").alias("n")).select("id", "x.*", "seq", "n")


def stream_edits(tasks: DataFrame, read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], size: int = BATCH):
    """A writer for a stream of tasks: micro-batches come one at a time, each is applied in pieces of `size` and the new
    state is written as one version, so a failed batch leaves the last one in place."""

    def one(batch: DataFrame, n: int) -> None:
        if not batch.isEmpty():
            write_state(apply_all(read_state(), batch, size), n)

    return tasks.writeStream.foreachBatch(one)


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str | None = None) -> DataFrame:
    """Events by window and kind; with a watermark if they stream."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def cache_hits(reads: DataFrame, seq: str, text: str) -> DataFrame:
    """A query cache by normalised text: (query_key, original, hit_count, created, updated). The first use of a key makes
    its row, every later one counts."""
    keyed = reads.withColumn("query_key", query_key(text)).where("query_key <> ''")
    return keyed.groupBy("query_key").agg(F.min_by(text, seq).alias("original"), (F.count("*") - 1).alias("hit_count"), F.min(seq).alias("created"), F.max(seq).alias("updated"))


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a bounded stream to its end into a table in the shared folder. Every micro-batch has a folder of its own, so
    one that is tried again replaces what its first try left; a complete result is the last batch's."""
    spark, path, batches = stream.sparkSession, scratch(stream.sparkSession, "stream"), []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
        batches.append(n)

    place = checkpoint or scratch(spark, "progress")
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", place).foreachBatch(write).start()
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(batches)}" if mode == "complete" else path).select(*stream.columns)


def ring(rows: Iterator, size: int = RING) -> list:
    """The last `size` items, newest first."""
    from collections import deque

    return list(deque(rows, maxlen=size))[::-1]
