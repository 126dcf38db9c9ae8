"""Benchmark decontamination: a broadcast set of normalised test n-grams against each document's word windows.

Contract. A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window as a
whole. A document word is hit if it lies in any occurrence of a window. Nulls have no words. Items with a null id or
without words take no part; repeated item rows count once. Repeated document rows are each judged. Extra columns pass.
An empty benchmark hits nothing; an empty document table gives no rows.

Every window of the set that a hash finds is verified against the item's own words. One broadcast holds about
`slice_words` item words; a larger benchmark is dealt into slices by a hash of the item id, longer items in pieces that
overlap by a window less a word, and the documents pass through one mapper after another, so that no worker holds more
than one slice and no document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, WORD_TABLE, ascii_lower, ship, texts

#: Words of benchmark items in one broadcast, about.
SLICE_WORDS = 4_000_000
_WORD_BYTES = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WindowIndex:
    """Windows by length: their sorted hashes, and the items of each window's word ids."""

    def __init__(self, items: list[tuple[object, bytes]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set]] = {}
        for item, text in items:
            words = text.translate(WORD_TABLE).split()
            if item is None or not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32)
            n = min(size, len(ids))
            windows = self.items.setdefault(n, {})
            for k in range(len(ids) - n + 1):
                windows.setdefault(ids[k : k + n].tobytes(), set()).add(item)
        self.hashes = {
            n: np.unique(self.hash(np.array([np.frombuffer(w, np.int32) for w in windows]).T))
            for n, windows in self.items.items()
        }

    @staticmethod
    def hash(columns: np.ndarray) -> np.ndarray:
        """columns: the ids at the first place of each window, at the second, and so on."""
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = out * _BASE + c.astype(np.uint64) + np.uint64(1)
        return out

    def find(self, text: bytes) -> tuple[int, np.ndarray, set]:
        """Number of words, the hit words' places, and the items that occur."""
        words = text.translate(WORD_TABLE).split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        known = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(ids >= 0, out=known[1:])
        hit, found = np.zeros(len(ids) + 1, np.int32), set()
        for n, windows in self.items.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            hashes = self.hash([ids[at + j] for j in range(n)])
            place = np.minimum(np.searchsorted(self.hashes[n], hashes), len(self.hashes[n]) - 1)
            for p in at[self.hashes[n][place] == hashes]:
                if items := windows.get(ids[p : p + n].tobytes()):
                    found |= items
                    hit[p] += 1
                    hit[p + n] -= 1
        return len(words), np.flatnonzero(np.cumsum(hit[:-1])), found


def _runs(places: np.ndarray) -> list[list[int]]:
    """Sorted places as [start, end) runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return [[int(r[0]), int(r[-1]) + 1] for r in np.split(places, cut)]


def _marker(index, at: int, found: pa.DataType, names: list[str], cut: bool):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = index.value
        for batch in batches:
            columns = list(batch.columns)
            before = columns[-1].to_pylist()
            rows, whole = [], texts(columns[at])
            for text, old in zip(whole, before):
                n, places, items = held.find(text)
                if old and old["runs"]:
                    places = np.union1d(places, np.concatenate([np.arange(*r) for r in old["runs"]]))
                items = items | set(old["items"]) if old else items
                rows.append({"n_words": n, "runs": _runs(places), "items": sorted(items, key=str)})
            columns[-1] = pa.array(rows, found)
            if cut and any(r["runs"] for r in rows):
                old = columns[at].to_pylist()
                columns[at] = pa.array([remove_runs(w, r["runs"]) if r["runs"] else t for w, r, t in zip(whole, rows, old)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return mark


def find_windows(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "contamination", slice_words: int = SLICE_WORDS, cut: bool = False) -> DataFrame:
    """docs with a struct column `into`: n_words, runs (hit words as [start, end)), items (ids whose windows occur).

    cut: the hit words' spans leave the text too, in the same pass.
    """
    spark = docs.sparkSession
    ship(spark)
    words = F.regexp_extract_all(ascii_lower(F.col(item_text).cast("string")), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(item).alias("i"), words.alias("w")).dropna().where(F.size("w") > 0).distinct()
    slices = max(1, -(-(items.agg(F.sum(F.size("w"))).first()[0] or 0) // slice_words))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)), F.lit(slice_words))
    pieces = items.select("i", "w", F.explode(starts).alias("at")).select("i", "at", F.array_join(F.slice("w", F.col("at") + 1, slice_words + size - 1), " ").alias("t"))
    if isinstance(items.schema["i"].dataType, (T.StructType, T.ArrayType, T.MapType)):
        raise TypeError("item ids must be atomic")
    kind = items.schema["i"].dataType
    found = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(kind))])
    df = docs.withColumn("__found", F.lit(None).cast(found))
    for k in range(slices):
        rows = [(r.i, r.t.encode()) for r in pieces.where(F.pmod(F.xxhash64("i", "at"), F.lit(slices)) == k).collect()]
        index = spark.sparkContext.broadcast(WindowIndex(rows, size))
        schema = T.StructType(df.schema.fields)
        mark = _marker(index, docs.columns.index(text), to_arrow_type(found), df.columns, cut and k == slices - 1)
        df = df.mapInArrow(mark, schema)
    return df.withColumnRenamed("__found", into)


def remove_runs(text: bytes, runs: list[list[int]]) -> str:
    """The text without its words in the runs, from the first byte of a run's first word to the last of its last."""
    places = [m.span() for m in _WORD_BYTES.finditer(text)]
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", remove: str = "spans") -> DataFrame:
    """docs without what the benchmark holds, in the same columns.

    remove="documents" drops each document with a hit. remove="spans" cuts the hit words' spans out and drops only a
    document of which no word is left though it had some.
    """
    found = find_windows(docs, benchmark, size, text, into="__c", cut=remove == "spans")
    if remove == "documents":
        return found.where(F.size("__c.runs") == 0).select(docs.columns)
    if remove != "spans":
        raise ValueError("remove is spans or documents")

    n_hit = F.aggregate("__c.runs", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return found.where((n_hit == 0) | (n_hit < F.col("__c.n_words"))).select(docs.columns)


def report(found: DataFrame, key: str, column: str = "contamination") -> DataFrame:
    """Digest of find_windows(): one row per document."""
    c = F.col(column)
    n_hit = F.aggregate(c["runs"], F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    ids = F.array_sort(F.transform(c["items"], lambda x: x.cast("string")))
    return found.select(
        key,
        c["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
