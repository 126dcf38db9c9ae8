"""Columns of records: JSON-safe values, page addresses, rows of tokens with their masks and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blank, c


def json_safe(x: Column | str, kind: T.DataType) -> Column:
    """The value with null for every NaN and infinity, at any depth; dates, times and bytes as strings."""
    v = c(x)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    if isinstance(kind, T.ArrayType):
        return F.transform(v, lambda y: json_safe(y, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(v, lambda k, y: json_safe(y, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(v.isNotNull(), F.struct(*(json_safe(v[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return v.cast("string")
    return v


def _page_field(metadata: Column | str, fields: list[str]) -> Column:
    own, others = fields[0], fields
    at = [f"$.{own}"] + [f"$.{row}.{f}" for row in ("source_row", "original_metadata.source_row") for f in others] + [f"$.source_rows[0].{own}"]
    found = [F.get_json_object(c(metadata), p) for p in at]
    return F.coalesce(*(F.when(~blank(x), F.trim(x)) for x in found))


def page_url(metadata: Column | str) -> Column:
    """The page's address in a record's JSON metadata: its own, its source row's, its original's, its first source row's."""
    return _page_field(metadata, ["wikipedia_url", "evidence_page_url"])


def page_title(metadata: Column | str) -> Column:
    return _page_field(metadata, ["wikipedia_title"])


def reward_at_last(score: Column | str, mask: Column | str) -> Column:
    """Zeros with the score at the last place whose mask is 1; without such a place, at the very last."""
    m = c(mask)
    n = F.aggregate(m, F.lit(0), lambda s, x: s + x.cast("int"))
    at = F.when(n > 0, n - 1).otherwise(F.size(m) - 1)
    return F.transform(m, lambda x, i: F.when(i == at, c(score).cast("double")).otherwise(0.0))


def reward_pair(prompt: Column | str, chosen: Column | str, rejected: Column | str, n: int, eos: int | None = None) -> Column:
    """struct(ids, mask): the prompt with either response, chosen first, each in exactly n places, zeros behind."""
    end = F.array() if eos is None else F.array(F.lit(eos))

    def row(response: Column | str) -> tuple[Column, Column]:
        ids = F.slice(F.concat(c(prompt), c(response), end.cast("array<int>")), 1, n)
        return ids, F.array_repeat(F.lit(0), n - F.size(ids))

    rows = [row(chosen), row(rejected)]
    return F.struct(
        F.array(*(F.concat(ids, fill) for ids, fill in rows)).alias("ids"),
        F.array(*(F.concat(F.transform(ids, lambda x: F.lit(1)), fill) for ids, fill in rows)).alias("mask"),
    )
