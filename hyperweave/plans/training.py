"""Trajectory data flow: repeated prompts, scores, penalties, advantages and metrics as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import advantages as A
from ..operators.partition import repeated


def step(rollouts: DataFrame, score: Column, kl: Column, group: str, beta: float = 0.001, estimator: str = "grpo") -> DataFrame:
    """Rollouts with score, reward and advantage."""
    rows = rollouts.withColumn("score", score).withColumn("kl", kl).withColumn("__m", F.lit(1))
    rows = A.shaped(rows, "score", "kl", "__m", beta).drop("__m")
    kinds = {"grpo": A.grpo, "rloo": A.rloo}
    if estimator not in kinds:
        raise ValueError(f"unknown estimator {estimator!r}")
    return kinds[estimator](rows, group, "reward")


def step_metrics(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    return A.batch_metrics(rows, [c for c in ("score", "reward", "advantage", "kl") if c in rows.columns], by)


def prompts(df: DataFrame, n: int, pos: str) -> DataFrame:
    """Every prompt n times, its copies together."""
    return repeated(df, n, True, pos)


def collected(samples: DataFrame, prompt: str, response: str, pos: str) -> DataFrame:
    """One row for each prompt with its responses in order."""
    return samples.groupBy(prompt).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(response).alias("r")))), lambda x: x["r"]).alias("responses"))


def trajectory_totals(turns: DataFrame, trajectory: str, pos: str, penalty: float = -0.1) -> DataFrame:
    """turns: (trajectory, pos, action, valid, effective, reward). Lists of each, turns, and rewards less penalties for invalid actions."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(c).alias("v")))), lambda x: x["v"]).alias(f"{c}s")
    total = F.sum(F.col("reward") + F.when(F.col("valid"), 0.0).otherwise(penalty)).alias("reward")
    return turns.groupBy(trajectory).agg(F.count("*").alias("turns"), order("action"), order("valid"), order("effective"), total)


def active_after(turns: DataFrame, trajectory: str, pos: str, text: str, most: int) -> DataFrame:
    """Trajectories that still call a tool in every turn up to `most`: (trajectory, turns, active)."""
    calls = F.col(text).contains("<tool_call>")
    return turns.where(F.col(pos) < most).groupBy(trajectory).agg(F.count("*").alias("turns"), F.max_by(calls, pos).alias("active"))
