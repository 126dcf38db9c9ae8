"""The reward manager: one plan that scores every response by its data source and places the score at its last token."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import reward_at_last

Scorer = Callable[[Column, Column], Column]


def reward_manager(batch: DataFrame, scorers: dict[str, Scorer], source: str, response: str, golds: str, mask: str, default: Scorer | None = None, rest: str | None = None) -> DataFrame:
    """batch with `score` and `reward` (zeros, the score at the last token of the mask).

    scorers: by data source, (response, golds) -> column; other sources take the default, and without one are an error.
    Null responses and golds score 0. rest: a column of scores that are known already; they are kept where not null."""
    r, g = F.coalesce(F.col(response), F.lit("")), F.coalesce(F.col(golds), F.array().cast("array<string>"))
    found = None
    for name, scorer in scorers.items():
        hit, value = F.col(source) == name, scorer(r, g).cast("double")
        found = F.when(hit, value) if found is None else found.when(hit, value)
    other = default(r, g).cast("double") if default else F.raise_error(F.concat(F.lit("no scorer for the data source "), F.coalesce(F.col(source), F.lit("null")))).cast("double")
    found = other if found is None else found.otherwise(other)
    score = F.coalesce(found, F.lit(0.0))
    score = F.when(F.col(rest).isNotNull(), F.col(rest).cast("double")).otherwise(score) if rest else score
    return batch.withColumn("score", score).withColumn("reward", reward_at_last("score", mask))
