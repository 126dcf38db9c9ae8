"""Edits as a keyed stateful stream: each task is answered at once, and what changed is flushed by count or by time.

The state of a working directory lies in the state store (RocksDB), not in memory: its records, an index of their keys,
and an index for lookups by a part of a content. The latter posts each record under the least hashes of its windows of
five substrings of six characters; any part of ten characters or more holds one such window as a whole, so its least hash
is posted for every record that contains it. What is found is verified. Posting lists are kept in stretches of `STRETCH`
ids, so a common beginning costs no more to extend than a rare one, and stale entries of renamed records stay until a
lookup passes them over.

Rows out. kind "result": the task's seq, status and id, as soon as its micro-batch is done. kind "flush": a changed record
as it now is, with the flush's number; a directory flushes when `size` records are dirty, or `seconds` after the first
of them (a processing-time timer), whichever is first; without `seconds` at the end of each of its micro-batches. Streams
with timers do not end by themselves, since Spark goes on for their timers. latest() lays flushes over a base table.

Contract. Tasks (working_dir, seq, update_type, content, new_content, content_key, new_key) of one micro-batch and directory run in the order of
`seq`; load rows (update_type "load", with id, weight, original_weight, deleted) bring an existing record in and answer nothing.
Lookups, inserts, renames and soft deletes are those of `edits`. Null or blank contents and unknown types fail. A stream
that is restarted from its checkpoint goes on where it was; results of a micro-batch that is tried again are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import query_key
from ..session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ids in one stretch of a posting list.
STRETCH = 64
OUT = "working_dir string, kind string, seq long, status string, id long, content string, weight double, original_weight double, deleted boolean, changed long, flush long"
RECORD = "content string, k string, weight double, original_weight double, deleted boolean, changed long"
TASK = ["working_dir", "seq", "update_type", "content", "new_content", "content_key", "new_key", "id", "weight", "original_weight", "deleted"]


def grams(text: str) -> set[int]:
    """The least hashes of all windows of five substrings of six characters; of a text of fewer than ten, none."""
    each = [zlib.crc32(text[i : i + 6].encode()) for i in range(len(text) - 5)]
    return {min(each[i : i + 5]) for i in range(len(each) - 4)}


def _null(x):
    return None if x is None or x != x else x


class Edits(StatefulProcessor):
    def __init__(self, size: int, seconds: float | None):
        self.size, self.seconds = size, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.records = handle.getMapState("records", "id long", RECORD)
        self.keys = handle.getMapState("keys", "k string", "ids array<long>")
        self.lengths = handle.getMapState("lengths", "gram long", "n long")
        self.postings = handle.getMapState("postings", "gram long, stretch long", "ids array<long>")
        self.dirty = handle.getMapState("dirty", "id long", "seq long")
        self.top = handle.getValueState("top", "id long, flush long, dirty long, timer long")

    # the state's indexes

    def _post(self, i: int, k: str) -> None:
        held = self.keys.getValue((k,))
        self.keys.updateValue((k,), (sorted({*(held[0] if held else ()), i}),))
        for g in grams(k):
            n = (self.lengths.getValue((g,)) or (0,))[0]
            stretch = (g, n // STRETCH)
            ids = self.postings.getValue(stretch)
            self.postings.updateValue(stretch, ([*(ids[0] if ids else ()), i],))
            self.lengths.updateValue((g,), (n + 1,))

    def _unpost(self, i: int, k: str) -> None:
        rest = [x for x in self.keys.getValue((k,))[0] if x != i]
        if rest:
            self.keys.updateValue((k,), (rest,))
        else:
            self.keys.removeKey((k,))

    def _find(self, k: str, skip_deleted: bool) -> int | None:
        held = self.keys.getValue((k,))
        for i in held[0] if held else ():
            if not (skip_deleted and self.records.getValue((i,))[4]):
                return i
        best = None
        if len(k) >= 10:
            lengths = {g: (self.lengths.getValue((g,)) or (0,))[0] for g in grams(k)}
            rarest = min(lengths, key=lambda g: (lengths[g], g))
            seen = set()
            for stretch in range(-(-lengths[rarest] // STRETCH)):
                seen.update(self.postings.getValue((rarest, stretch))[0])
            for i in sorted(seen):
                r = self.records.getValue((i,))
                if not (skip_deleted and r[4]) and k in r[1] and 2 * len(k) >= len(r[1]) and (best is None or len(k) / len(r[1]) > best[0]):
                    best = (len(k) / len(r[1]), i)
        return best[1] if best else None

    def _put(self, i: int, record: tuple) -> None:
        self.records.updateValue((i,), record)

    # tasks

    def _one(self, t, top: list[int]) -> tuple[str, int | None]:
        kind, k = t.update_type, t.content_key
        if kind not in ("insert", "update", "delete") or not k or (kind == "update" and not t.new_key):
            return "failed", None
        if kind == "insert":
            held = self.keys.getValue((k,))
            if held:
                return "skipped", held[0][0]
            top[0] += 1
            self._put(top[0], (t.content, k, 1.0, None, False, t.seq))
            self._post(top[0], k)
            return "succeeded", top[0]
        i = self._find(k, kind == "delete")
        if i is None:
            return "failed", None
        content, old, weight, original, deleted, _ = self.records.getValue((i,))
        if kind == "update":
            if t.new_key != old:
                self._unpost(i, old)
                self._post(i, t.new_key)
            if deleted:
                weight, original, deleted = (weight if original is None else original), None, False
            self._put(i, (t.new_content, t.new_key, weight, original, deleted, t.seq))
        else:
            self._put(i, (content, old, weight / 2 if weight > 0 else 0.05, weight if original is None else original, True, t.seq))
        return "succeeded", i

    def _flush(self, directory: str, top: list[int]) -> Iterator[pd.DataFrame]:
        """The dirty records, in pieces."""
        top[1], top[2] = top[1] + 1, 0
        out = []
        for i in [k for (k,), _ in self.dirty.iterator()]:  # the state answers one question at a time
            content, _, weight, original, deleted, changed = self.records.getValue((i,))
            out.append((directory, "flush", None, None, i, content, weight, original, deleted, changed, top[1]))
            if len(out) == 1000:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        self.dirty.clear()

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = {"seq": "Int64", "id": "Int64", "changed": "Int64", "flush": "Int64", "weight": "Float64", "original_weight": "Float64", "deleted": "boolean"}
        return pd.DataFrame(rows, columns=names).astype(kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.top.get()
        top = [*held] if held else [0, 0, 0, 0]
        tasks = []
        for frame in rows:
            for t in frame[TASK].itertuples(index=False):
                if t.update_type == "load":
                    i = int(t.id)
                    self._put(i, (t.content, t.content_key, float(t.weight), _null(t.original_weight), bool(t.deleted), 0))
                    self._post(i, t.content_key)
                    top[0] = max(top[0], i)
                else:
                    tasks.append(t)
        results = []
        for t in sorted(tasks, key=lambda t: t.seq):
            status, i = self._one(t, top)
            if status == "succeeded" and not self.dirty.containsKey((i,)):
                top[2] += 1
            if status == "succeeded":
                self.dirty.updateValue((i,), (int(t.seq),))
            results.append((key[0], "result", int(t.seq), status, i, None, None, None, None, None, None))
        if results:
            yield self._frame(results)
        if top[2] >= self.size or top[2] and self.seconds is None:
            yield from self._flush(key[0], top)
        if self.seconds is None:
            pass
        elif top[2] and not top[3]:
            top[3] = timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000)
            self.handle.registerTimer(top[3])
        elif not top[2] and top[3]:
            self.handle.deleteTimer(top[3])
            top[3] = 0
        self.top.update(tuple(top))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        top = [*self.top.get()]
        top[3] = 0
        yield from self._flush(key[0], top)
        self.top.update(tuple(top))

    def close(self) -> None:
        pass


def stream_tasks(tasks: DataFrame, size: int = 50, seconds: float | None = 60.0) -> DataFrame:
    """Results and flushes of a stream of tasks (and load rows)."""
    spark = tasks.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name, kind in (("id", "long"), ("weight", "double"), ("original_weight", "double"), ("deleted", "boolean"), ("new_content", "string")):
        if name not in tasks.columns:
            tasks = tasks.withColumn(name, F.lit(None).cast(kind))
    keyed = tasks.withColumns({"content_key": query_key("content"), "new_key": query_key("new_content")}).select(*TASK)
    return keyed.groupBy("working_dir").transformWithStateInPandas(Edits(size, seconds), OUT, "Update", "None" if seconds is None else "ProcessingTime")


def load_rows(state: DataFrame) -> DataFrame:
    """Existing records as rows of the stream, to come before its tasks."""
    null = F.lit(None).cast("string")
    return state.select("working_dir", F.lit(0).cast("long").alias("seq"), F.lit("load").alias("update_type"), "content", null.alias("new_content"), "id", "weight", "original_weight", "deleted")


def latest(base: DataFrame, out: DataFrame) -> DataFrame:
    """The base table (columns of edits.STATE) with the last flush of each record laid over it."""
    last = Window.partitionBy("working_dir", "id").orderBy(F.desc("flush"))
    new = out.where("kind = 'flush'").withColumn("__r", F.row_number().over(last)).where("__r = 1").select(*base.columns)
    return base.join(new, ["working_dir", "id"], "left_anti").select(*base.columns).unionByName(new)
