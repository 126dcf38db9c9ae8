"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. In each block of vectors, every pivot has an inverted file
of the vectors that list it, ordered by the place at which they do. A query walks the files of its own first pivots, of
each only the stretch of places near its own, and adds up, for every vector that it meets, how little the two orders
differ (Spearman's footrule, a pivot missing from a list standing at its end). The block's best by footrule are reranked
by the true measure, and the blocks' answers are merged.

Equal vectors are indexed once, with their smallest ids. Queries reach the blocks in broadcast slices of at most
`SLICE` vectors; more queries take more passes. Vectors of different lengths have no measure between them and are
indexed apart.

Contract. Nearness is the largest cosine in double precision; ties go to the smaller id. A vector that is null, zero or
empty, or that holds null or non-finite components, takes no part, nor does a row with a null id. Components may be as
large or small as doubles are: vectors are scaled by a power of two, which leaves the cosine as it is. Repeated ids
count as separate rows, except that a query never answers with its own id. With fewer rows of its length than asked for,
a query gets all. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

#: Pivots, the length of a vector's list of them, how many files a query walks, and how far from its own place in each.
#: Pivots are chosen from a bounded sample, the `SAMPLED` vectors whose hashes are smallest, so that no two have a cosine
#: over `ALIKE`: copies of one pivot would crowd the lists.
PIVOTS, LISTED, WALKED, REACH = 1024, 96, 64, 40
SAMPLED, ALIKE = 4096, 0.8
#: Share of the best agreement from which a row is reranked whatever its place.
CLOSE = 0.8
#: Vectors in a block, and what part of a block is reranked: a tenth, and no fewer than `LEAST` for each answer asked for.
BLOCK, PART, LEAST = 10_000, 10, 20
#: Queries in one broadcast.
SLICE = 8192


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v")).where(finite & some)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest components below 1: no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])


def unlike(sample: np.ndarray, n: int) -> np.ndarray:
    """The first n vectors of the sample that are not like an earlier one."""
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    kept, free = [], np.ones(len(sample), bool)
    for k in range(len(sample)):
        if free[k]:
            kept.append(k)
            free &= unit @ unit[k] <= ALIKE
            if len(kept) == n:
                break
    return sample[kept]


class PivotOrders:
    """Lists of nearest pivots, by cosine."""

    def __init__(self, pivots: np.ndarray, listed: int):
        self.pivots = pivots / np.sqrt((pivots * pivots).sum(1, keepdims=True))
        self.listed = min(listed, len(pivots))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, self.listed), np.int32)]
        for at in range(0, len(vectors), 2048):
            apart = vectors[at : at + 2048] @ -self.pivots.T
            first = np.argpartition(apart, self.listed - 1, axis=1)[:, : self.listed]
            order = np.argsort(np.take_along_axis(apart, first, 1), axis=1, kind="stable")
            out.append(np.take_along_axis(first, order, 1).astype(np.int32))
        return np.concatenate(out)


class Block:
    """Pivot inverted files over some vectors, each ordered by place."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.listed = orders.shape
        posted = (orders * np.int32(self.listed) + np.arange(self.listed, dtype=np.int32)).ravel()
        by = np.argsort(posted, kind="stable")
        self.rows, self.places = (by // self.listed).astype(np.int32), (by % self.listed).astype(np.int32)
        self.at = np.concatenate([[0], np.cumsum(np.bincount(posted, minlength=n_pivots * self.listed))])

    def agreement(self, order: np.ndarray, walked: int = WALKED, reach: int = REACH) -> np.ndarray:
        """Of every row, the list's length less the difference of places, summed over the stretches walked."""
        place = np.arange(min(walked, self.listed))
        files = order[: len(place)].astype(np.int64) * self.listed
        low, high = self.at[files + np.maximum(place - reach, 0)], self.at[files + np.minimum(place + reach + 1, self.listed)]
        n = high - low
        posted = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        return np.bincount(self.rows[posted], self.listed - np.abs(self.places[posted] - np.repeat(place, n)), self.n)

    def nearest(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows of least footrule to the order, and all others that agree with it as well as `CLOSE` of the best:
        a dense cluster's orders hardly differ, so all of it is reranked."""
        if n >= self.n:
            return np.arange(self.n)
        agree = self.agreement(order)
        return np.flatnonzero(agree >= min(np.partition(agree, -n)[-n], CLOSE * agree.max()))


def search(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, listed: int = LISTED, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of which is_query (over `id`) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    order = Window.partitionBy("v").orderBy("id")
    # of equal vectors, k + 1 ids answer any query, its own id among them
    kept = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    distinct = settled(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = settled(rows.where(is_query))
    answer = "query_id long, rank int, vec_id long, score double"
    found = []
    for width in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):
        found += _search_width(distinct.where(F.size("v") == width), asked.where(F.size("v") == width), width, k, pivots, listed, part)
    if not found:
        return spark.createDataFrame([], answer)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = reduce(DataFrame.unionByName, found)
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_width(distinct: DataFrame, queries: DataFrame, width: int, k: int, pivots: int, listed: int, part: int) -> list[DataFrame]:
    """(query_id, vec_id, score): what every block of the vectors of one length answers."""
    spark = distinct.sparkSession
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLED).collect()
    held = unlike(scaled(np.array([r.v for r in chosen])), pivots)
    orders = spark.sparkContext.broadcast(PivotOrders(held, listed))
    slices = max(1, -(-queries.count() // SLICE))

    def find(asked):
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, (q_ids, q, q_orders) = orders.value, asked.value
            norms = np.sqrt((q * q).sum(1))

            def answers(batch: pa.Table) -> Iterator[pa.RecordBatch]:
                v = scaled(batch.column(0).combine_chunks().flatten().to_numpy().reshape(-1, width))
                ids, size = batch.column(1).to_pylist(), np.sqrt((v * v).sum(1))
                block = Block(index.of(v), len(index.pivots))
                out = []
                for j in range(len(q_ids)):
                    at = block.nearest(q_orders[j], max(LEAST * k, -(-block.n // part)))
                    score = (v[at] * q[j]).sum(1) / (size[at] * norms[j])
                    # a vector answers with at least one id, so k + 1 of them always do
                    best = np.flatnonzero(score >= np.partition(score, -(k + 1))[-(k + 1)]) if len(at) > k + 1 else np.arange(len(at))
                    found = [(s, i) for s, x in zip(score[best], at[best]) for i in ids[x] if i != q_ids[j]]
                    out += [(int(q_ids[j]), i, float(s)) for s, i in sorted(found, key=lambda f: (-f[0], f[1]))[:k]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= BLOCK:
                    yield from answers(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
            if n:
                yield from answers(pa.Table.from_batches(waiting))

        return mapped

    found = []
    for part_no in range(slices):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part_no).collect()  # about SLICE rows
        if asked:
            q = scaled(np.array([r.v for r in asked]))
            sent = spark.sparkContext.broadcast(([r.id for r in asked], q, orders.value.of(q)))
            found.append(distinct.select("v", "ids").mapInArrow(find(sent), "query_id long, vec_id long, score double"))
    return found
