"""Validation, profiling and summaries of nested question-answer datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, first_present

RECORD_VERSION = "2"
REQUIRED = ["data_id", "image_id", "image_path", "data_source", "ability"]


def violations(*checks: tuple[Column, str]) -> Column:
    """Messages of all conditions that hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for bad, m in checks)))


def validate_records(records: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """Records with `violations`: blank required fields, no prompt, an inline image mark, another schema version."""
    checks = [(blank(F.col(c).cast("string")), f"{c} is blank") for c in required]
    if "prompt" in records.columns:
        checks += [(F.size("prompt") < 1, "no prompt"), (F.exists("prompt", lambda p: p["content"].contains("<image>")), "prompt holds <image>")]
    if "extra_info" in records.columns:
        checks += [(F.col("extra_info.mm_schema_version") != RECORD_VERSION, "schema version"), (F.size("extra_info.golden_answers") < 1, "no golden answers")]
    if "images" in records.columns:
        checks += [(F.lit(True), "images is not allowed")]
    return records.withColumn("violations", violations(*checks))


def answers(values: Column | str) -> Column:
    """Trimmed answers without blanks, each once, in order."""
    v = F.col(values) if isinstance(values, str) else values
    return F.array_distinct(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def qa_record(rows: DataFrame, instruction: str, source: str = "qa") -> DataFrame:
    """rows: (split, index, question, answer, golden_answers) as training records."""
    content = F.concat(F.lit(instruction), F.col("question"))
    return rows.select(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.lit("qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), answers("golden_answers").alias("ground_truth")).alias("reward_model"),
        F.struct("split", F.col("index").cast("string").alias("index"), "answer", "question").alias("extra_info"),
    )


def mm_record(rows: DataFrame) -> DataFrame:
    """rows: (dataset, split, index, question, golden_answers, image_id, image_path, context). Multimodal records; a
    missing data_id is built from the other keys."""
    data_id = F.concat_ws(":", "dataset", "split", F.col("index").cast("string"), "image_id")
    return rows.select(
        "context",
        F.col("dataset").alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("prompt"),
        F.lit("multimodal_qa").alias("ability"),
        F.struct(F.lit("rule").alias("style"), answers("golden_answers").alias("ground_truth")).alias("reward_model"),
        F.struct("dataset", "split", F.col("index").cast("string").alias("index"), "question", answers("golden_answers").alias("golden_answers"), "image_id", "image_path", blank("image_path").alias("image_missing"), F.lit(RECORD_VERSION).alias("mm_schema_version")).alias("extra_info"),
        data_id.alias("data_id"),
        "image_id",
        "image_path",
    )


def normalise_build_row(rows: DataFrame, fields: list[str], nested: str = "extra_info") -> DataFrame:
    """Blank fields filled from the nested record."""
    held = rows.schema[nested].dataType.names
    return rows.withColumns({f: first_present(F.col(f), F.col(f"{nested}.{f}")) if f in held else F.col(f) for f in fields})


def contents(title: str, section: str, evidence: str, most: int | None = None) -> Column:
    """Title, section and evidence, white space collapsed, parted by blank lines; blanks are skipped."""
    text = F.regexp_replace(F.trim(evidence), r"\s+", " ")
    parts = [F.trim(title), F.trim(section), F.substring(text, 1, most) if most else text]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")


def quality_counters(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Rows and missing values of every column, over all or by group."""
    out = [F.count("*").alias("rows"), *(F.count_if(blank(F.col(c).cast("string"))).alias(f"missing_{c}") for c in columns)]
    return df.groupBy(*by).agg(*out) if by else df.agg(*out)


def eligibility(df: DataFrame, key: str, pos: str, reasons: list[tuple[Column, str]]) -> DataFrame:
    """Rows with the first reason against them; a key's later rows are duplicates; `eligible` without a reason."""
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy(key).orderBy(pos)) > 1
    reason = F.when(again, "duplicate")
    for bad, name in reasons:
        reason = reason.when(bad, name)
    return df.withColumn("reason", reason.otherwise("eligible"))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def alignment_summary(matches: DataFrame, row: str, by: list[str], n: str | None = None) -> DataFrame:
    """(dimension, value, n): all matches by match_key, distinct raw rows by every other dimension. n: how many matches a row stands for."""
    out = matches.groupBy(F.lit("match_key").alias("dimension"), F.col("match_key").alias("value")).agg((F.sum(n) if n else F.count("*")).alias("n"))
    for d in by:
        out = out.unionByName(matches.select(row, d).distinct().groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.count("*").alias("n")))
    return out


def completeness(done: DataFrame, requested: DataFrame, split: str) -> DataFrame:
    """Splits with fewer complete rows than asked for."""
    have = done.groupBy(split).agg(F.count("*").alias("complete"))
    return requested.join(have, split, "left").fillna(0, ["complete"]).where(F.col("complete") < F.col("requested"))


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """(kind, n, keys): type of the parsed value, rows, and the sorted top-level keys that occur."""
    v = F.try_parse_json(column)
    kind = F.when(F.col(column).isNull(), "missing").when(v.isNull(), "invalid").otherwise(F.regexp_extract(F.lower(F.schema_of_variant(v)), "^[a-z]+", 0))
    keys = F.json_object_keys(column)
    each = df.select(kind.alias("kind"), F.explode_outer(keys).alias("key"), F.monotonically_increasing_id().alias("row"))
    return each.groupBy("kind").agg(F.count_distinct("row").alias("n"), F.array_sort(F.collect_set("key")).alias("keys"))


def readiness(checks: DataFrame, group: str) -> DataFrame:
    """checks: (group, name, ok). One row for each group: ready or not, with the names of what blocks it."""
    return checks.groupBy(group).agg(F.bool_and("ok").alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("blockers"))


def payload_pairs(df: DataFrame, column: str) -> DataFrame:
    """(key, value) of a JSON object or of a list of objects."""
    listed = F.from_json(column, "array<map<string,string>>")
    single = F.array(F.from_json(column, "map<string,string>"))
    maps = F.when(F.trim(column).startswith("["), listed).otherwise(single)
    return df.select(F.explode(maps).alias("m")).select(F.explode("m").alias("key", "value"))


def merged_maps(old: Column, new: Column) -> Column:
    """Shallow update: the new map's non-null entries win."""
    fresh = F.map_filter(new, lambda k, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def asset_report(assets: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """assets: (name, sha256, size); files: (name, content). Whether each file is there and is the right one."""
    have = files.select(key, F.sha2("content", 256).alias("have_sha256"), F.length("content").alias("have_size"))
    status = F.when(F.col("have_sha256").isNull(), "missing").when(F.col("size").isNotNull() & (F.col("size") != F.col("have_size")), "wrong size").when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("have_sha256")), "wrong checksum").otherwise("ok")
    return assets.join(have, key, "left").withColumn("status", status)
