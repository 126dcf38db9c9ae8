"""Exact vector search and vector arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled, ship

#: Queries in one broadcast of an exact search; more take more passes over the vectors.
SLICE = 8192
#: Scores that a task holds at a time: queries are taken in blocks of so many that these times a batch's rows stay below.
CELLS = 1 << 21


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalised(v: Column | str) -> Column:
    """v over its length; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def truncated(v: str, n: int) -> Column:
    """The first n components, renormalised only if that cuts any."""
    return F.when(F.size(v) > n, normalised(F.slice(v, 1, n))).otherwise(F.transform(v, lambda x: x.cast("double")))


def quantised(v: Column | str) -> Column:
    """Affine 8-bit codes: struct of codes, low and high; rounded half to even."""
    low, high = F.array_min(v), F.array_max(v)
    width = F.when(high == low, 1.0).otherwise((high - low).cast("double"))
    return F.struct(F.transform(v, lambda x: F.bround((x - low).cast("double") * 255 / width, 0).cast("int")).alias("codes"), low.alias("low"), high.alias("high"))


def dequantised(q: str) -> Column:
    c = F.col(q)
    return F.transform(c["codes"], lambda x: x * (c["high"] - c["low"]).cast("double") / 255 + c["low"])


def _best(batches: Iterator[pa.RecordBatch], names: list, q: np.ndarray, n: int, key: str, measure: str, least: float | None) -> Iterator[pa.RecordBatch]:
    """Each batch's n best for each query, a block of queries at a time; with all ties of the last, without what scores below `least`."""
    names = pa.array(names)
    unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    q = q if measure == "ip" else unit(q)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
        v = v if measure == "ip" else unit(v)
        m, step = min(n, batch.num_rows), max(1, CELLS // batch.num_rows)
        for at in range(0, len(q), step):
            score = q[at : at + step] @ v.T
            cut = -np.partition(-score, m - 1, axis=1)[:, m - 1]
            row, col = np.nonzero(score >= (cut if least is None else np.maximum(cut, least))[:, None])
            if len(row):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row + at)), batch.column(0).take(pa.array(col)), pa.array(score[row, col])], ["query", key, "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", measure: str = "ip", least: float | None = None, over: int = 1) -> DataFrame:
    """(query, key, score, rank): the exact k best vectors of each query by inner product or cosine, ties by key.

    queries: (query, embedding). They reach the scan in broadcast slices of at most SLICE rows; each Arrow batch answers
    with its own best, found by matrix products of at most CELLS scores, and only those are shuffled. least: smallest score kept, applied
    before ranking (over=1) or, as an over-fetching store does, after the over * k best are taken.
    """
    spark = vectors.sparkSession
    ship(spark)
    n = over * k
    kind = vectors.schema[key].dataType.simpleString()
    passes = max(1, -(-queries.count() // SLICE))
    parts = []
    for p in range(passes):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == p).select("query", "embedding").collect()
        if not asked:
            continue
        held = spark.sparkContext.broadcast(([r.query for r in asked], np.array([r.embedding for r in asked], float)))

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            return _best(batches, *held.value, n, key, measure, least)

        query_kind = queries.schema["query"].dataType.simpleString()
        parts.append(vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(best, f"query {query_kind}, `{key}` {kind}, score double"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    if least is not None and over == 1:
        out = out.where(F.col("score") >= least)
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    if over > 1:
        out = out.where(F.col("score") >= (least if least is not None else float("-inf"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out


def check_index(vectors: DataFrame, key: str = "id", vector: str = "embedding", dimension: int | None = None) -> DataFrame:
    """One row: count, distinct ids, dimensions, and the blockers that would keep the index from being served."""
    row = vectors.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high"))
    wrong = [(F.col("n") == 0, "empty"), (F.col("n") != F.col("ids"), "duplicate ids"), (F.col("low") != F.col("high"), "mixed dimensions")]
    if dimension is not None:
        wrong.append((F.col("high") != dimension, "wrong dimension"))
    return row.withColumn("blockers", F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in wrong))))


def reindex(new: DataFrame, old: DataFrame, encode) -> DataFrame:
    """new: (pos, content); old: (pos, content, embedding). Embeddings are reused by content, the i-th copy taking the
    i-th old one's; only what is left is encoded (a Column function of the content). Order is kept."""
    copy = lambda d: d.withColumn("h", F.md5("content")).withColumn("copy", F.row_number().over(Window.partitionBy("h").orderBy("pos")))
    joined = settled(copy(new).join(copy(old).select("h", "copy", F.col("embedding").alias("kept")), ["h", "copy"], "left"))
    # apart, since a Python encoder would otherwise see every row, whatever condition stands around it
    held = joined.where(F.col("kept").isNotNull()).select("pos", "content", F.col("kept").alias("embedding"), F.lit(True).alias("reused"))
    fresh = joined.where(F.col("kept").isNull()).select("pos", "content", encode(F.col("content")).alias("embedding"), F.lit(False).alias("reused"))
    return held.unionByName(fresh)


def hash_encoder(dimension: int = 1024):
    """A deterministic text encoder as a pandas UDF: hashed characters and words, of length 1; blank text gives zeros."""
    import hashlib


    @F.pandas_udf(T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR)
    def encode(values):
        def one(text):
            out = np.zeros(dimension)
            if text and text.strip():
                for weight, parts in ((1.0, text.lower().split()), (0.5, [text[i : i + 3] for i in range(max(1, len(text) - 2))])):
                    for part in parts:
                        h = hashlib.sha256(part.encode()).digest()
                        out[int.from_bytes(h[:4], "big") % dimension] += weight * (1 if h[4] & 1 else -1)
                n = np.sqrt((out * out).sum())
                out = out / n if n else out
            return out.astype(np.float32).tolist()

        return values.map(one)

    return encode


def mock_encoder(dimension: int = 64):
    """Unit Gaussian vectors seeded by the SHA-256 of their text, as a pandas UDF."""
    import hashlib

    @F.pandas_udf(T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR)
    def encode(values):
        def one(text):
            v = np.random.default_rng(int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "big")).normal(size=dimension)
            return (v / np.sqrt((v * v).sum())).astype(np.float32).tolist()

        return values.map(one)

    return encode
