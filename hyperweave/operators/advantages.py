"""Group-relative advantages, returns and batch metrics of trajectories."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship


def grpo(df: DataFrame, group: str, score: str, eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (sample deviation + eps) within a group; a lone row has mean 0 and deviation 1."""
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    mean = F.when(n > 1, F.avg(score).over(w)).otherwise(0.0)
    dev = F.when(n > 1, F.stddev_samp(score).over(w)).otherwise(1.0)
    return df.withColumn("advantage", (F.col(score) - mean) / (dev + eps))


def rloo(df: DataFrame, group: str, score: str) -> DataFrame:
    """Each score against the mean of the others; a lone score stays."""
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, F.col(score) * n / (n - 1) - F.avg(score).over(w) * n / (n - 1)).otherwise(F.col(score).cast("double")))


def reverse_scan(values: Column, factors: Column) -> Column:
    """Array of y_t = x_t + f_t * y_(t+1), from the end on, in one pass; null where an array is null."""

    @pandas_udf("array<double>")
    def scan(x: pd.Series, f: pd.Series) -> pd.Series:
        def one(a, b):
            if a is None or b is None:
                return None
            steps = zip(a[::-1].tolist(), b[::-1].tolist())
            return list(accumulate(steps, lambda y, s: s[0] + s[1] * y, initial=0.0))[:0:-1]

        return pd.Series([one(a, b) for a, b in zip(x, f)], dtype=object)

    return scan(values.cast("array<double>"), factors.cast("array<double>"))


def reward_to_go(df: DataFrame, trajectory: str, pos: str, reward: str, gamma: float = 1.0, into: str = "returns") -> DataFrame:
    """Rows with the discounted sum of their trajectory's rewards from there on. With a discount a trajectory's rows meet
    as one array, whose returns one scan finds."""
    if gamma == 1.0:
        w = Window.partitionBy(trajectory).orderBy(pos).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return df.withColumn(into, F.sum(reward).over(w))
    whole = df.select(trajectory, F.struct(F.col(pos).alias("__pos"), F.struct(*df.columns).alias("row")).alias("x"))
    rows = whole.groupBy(trajectory).agg(F.array_sort(F.collect_list("x")).alias("x"))
    rewards = F.transform("x", lambda x: x["row"][reward].cast("double"))
    scanned = rows.select("x", reverse_scan(rewards, F.transform(rewards, lambda r: F.lit(gamma))).alias("y"))
    return scanned.select(F.explode(F.arrays_zip("x", "y")).alias("z")).select("z.x.row.*", F.col("z.y").alias(into))


def remax(df: DataFrame, trajectory: str, pos: str, reward: str, mask: str, baseline: str) -> DataFrame:
    masked = df.withColumn("__r", F.col(reward) * F.col(mask))
    return reward_to_go(masked, trajectory, pos, "__r").drop("__r").withColumn("advantage", F.col("returns") - F.col(baseline) * F.col(mask))


def masked_moments(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row: sum, mean and sample variance of the values whose mask is 1."""
    v = F.when(F.col(mask) == 1, F.col(value))
    return df.agg(F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.count(v).alias("n"))


def whitened(df: DataFrame, value: str, mask: str, into: str = "whitened") -> DataFrame:
    """Values less the masked mean, over the masked deviation of all rows."""
    m = masked_moments(df, value, mask).select("mean", "var")
    return df.join(F.broadcast(m)).withColumn(into, (F.col(value) - F.col("mean")) * F.pow(F.col("var") + 1e-8, -0.5) * F.col(mask)).drop("mean", "var")


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Array of returns R_t = r_t + gamma * R_(t+1), starting anew after a masked place."""
    after = F.concat(F.slice(mask, 2, F.greatest(F.size(mask), F.lit(1))).cast("array<double>"), F.array(F.lit(0.0)))
    return reverse_scan(rewards, F.transform(after, lambda m: m * gamma))


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Array of advantages from arrays of rewards and values; the value after the last is 0."""
    after = F.concat(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, after, lambda r, n: r + gamma * n), values, lambda x, v: x - v)
    return reverse_scan(delta, F.transform(delta, lambda d: F.lit(gamma * lam)))


def shaped(df: DataFrame, score: str, kl: str, mask: str, beta: float) -> DataFrame:
    return df.withColumn("reward", F.col(score) - beta * F.col(kl) * F.col(mask))


def batch_metrics(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Mean, least and greatest of every column."""
    out = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def explained_variance(df: DataFrame, returns: str, values: str) -> DataFrame:
    return df.agg((1 - F.var_samp(F.col(returns) - F.col(values)) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))


def pass_at_k(df: DataFrame, problem: str, score: str) -> DataFrame:
    """Share of problems of which some candidate scores 1."""
    return df.groupBy(problem).agg((F.max(score) == 1).cast("double").alias("hit")).agg(F.avg("hit").alias("pass_at_k"))


def clipped_surrogate(ratio: Column, advantage: Column, eps: float) -> Column:
    return F.greatest(-advantage * ratio, -advantage * F.greatest(F.lit(1 - eps), F.least(F.lit(1 + eps), ratio)))


def state_coverage(df: DataFrame, loss_mask: str, response_mask: str) -> DataFrame:
    """Tokens that the loss counts, and their share of the response's."""
    return df.agg(F.sum(loss_mask).alias("tokens"), (F.sum(loss_mask) / F.sum(response_mask)).alias("coverage"))


def timing(df: DataFrame, section: str, seconds: str, tokens: str) -> DataFrame:
    """Seconds, tokens and milliseconds for each token, by section."""
    return df.groupBy(section).agg(F.sum(seconds).alias("seconds"), F.sum(tokens).alias("tokens")).withColumn("ms_per_token", F.try_divide(F.col("seconds") * 1000, F.col("tokens")))


def policy_loss(df: DataFrame, old: str, new: str, advantage: str, mask: str, eps: float = 0.2) -> DataFrame:
    """One row: the masked mean of the clipped surrogate, the share of clipped tokens, and the masked mean of -log ratio."""
    ratio = F.exp(F.col(new) - F.col(old))
    plain = -F.col(advantage) * ratio
    clipped = clipped_surrogate(ratio, F.col(advantage), eps)
    n = F.sum(mask)
    return df.agg((F.sum(clipped * F.col(mask)) / n).alias("loss"), (F.sum((clipped > plain).cast("int") * F.col(mask)) / n).alias("clip_fraction"), (F.sum((F.col(old) - F.col(new)) * F.col(mask)) / n).alias("kl"))


def value_loss(df: DataFrame, predicted: str, old: str, returns: str, mask: str, eps: float = 0.2) -> DataFrame:
    low, high = F.col(old) - eps, F.col(old) + eps
    clipped = F.greatest(low, F.least(high, F.col(predicted)))
    a, b = F.pow(F.col(predicted) - F.col(returns), 2), F.pow(clipped - F.col(returns), 2)
    return df.agg((0.5 * F.sum(F.greatest(a, b) * F.col(mask)) / F.sum(mask)).alias("loss"), (F.sum((b > a).cast("int") * F.col(mask)) / F.sum(mask)).alias("clip_fraction"))


def bootstrap_metrics(df: DataFrame, source: str, problem: str, attempt: str, score: str, answer: str | None = None, sizes: list[int] = (2, 4, 8), draws: int = 1000, seed: int = 42) -> DataFrame:
    """(source, metric, size, mean, std): what validation reports of repeated attempts, averaged over a source's problems.

    mean@n over all of a problem's attempts; best@k, worst@k and, with answers, maj@k over `draws` samples of k attempts
    each, drawn with replacement. A draw is a hash of seed, problem, k, sample and place, so it is the same on every run and
    in SQL. The majority's score is that of the first drawn attempt with the most frequent answer, the first drawn among
    equally frequent ones. std is the population's over the samples; of mean@n over the attempts. A problem's attempts
    (some tens) meet in one row; nulls in score are no attempts."""
    picked = df.where(F.col(score).isNotNull())
    told = F.struct(F.col(attempt).alias("i"), F.col(score).cast("double").alias("s"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a"))
    each = picked.groupBy(source, problem).agg(F.array_sort(F.collect_list(told)).alias("x"))
    name = F.concat_ws(":", F.lit(str(seed)), F.col(problem).cast("string"))
    each = each.select(source, name.alias("name"), F.transform("x", lambda v: v["s"]).alias("s"), F.transform("x", lambda v: v["a"]).alias("a"))
    metrics = ["best", "worst", *(["maj"] if answer else [])]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = None, {}
        for batch in batches:
            out = []
            for whose, name, s, a in zip(*(c.to_pylist() for c in batch.columns)):
                if name != held:
                    held, numbers = name, {k: _draws(name, k, draws) for k in sizes}
                s, codes = np.array(s, dtype=float), {}
                a = np.array([codes.setdefault(v, len(codes)) for v in a])
                for k in sizes:
                    at = numbers[k] % len(s)
                    y = s[at]
                    found = {"best": y.max(axis=1), "worst": np.fmin.reduce(y, axis=1)}  # a NaN is the greatest, as in SQL
                    if answer:
                        votes = a[at]
                        most = (votes[:, :, None] == votes[:, None, :]).sum(axis=2).argmax(axis=1)  # the first of equally frequent ones
                        found["maj"] = y[np.arange(draws), most]
                    out += [(whose, m, k, float(found[m].mean()), float(found[m].std())) for m in metrics]
            if out:
                types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [source, "metric", "size", "mean", "std"])

    ship(df.sparkSession)
    kind = df.schema[source].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what is drawn depends on the problem alone: problems of the same name stand together, and their sources share the draws
    sums = each.repartition(parts, "name").sortWithinPartitions("name").mapInArrow(measured, f"`{source}` {kind}, metric string, size int, mean double, std double")
    plain = picked.groupBy(source, problem).agg(F.count("*").cast("int").alias("size"), F.avg(F.col(score).cast("double")).alias("mean"), F.stddev_pop(F.col(score).cast("double")).alias("std"))
    found = sums.unionByName(plain.select(source, F.lit("mean").alias("metric"), "size", "mean", "std"))
    return found.groupBy(source, "metric", "size").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))


def _draws(name: str, k: int, draws: int) -> np.ndarray:
    """The numbers of 32 bits that samples of k attempts are drawn by, a row for each sample."""
    digests = b"".join(md5(f"{name}:{k}:{b}:{j}".encode()).digest() for b in range(draws) for j in range(k))
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64).reshape(draws, k)
