"""Payloads of searches and edits: compaction, scopes, profiles and coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import blank, c, first_present


def compact_images(results: DataFrame, query: str, entity: str, order: str, keep: list[str], n: int = 3) -> DataFrame:
    """Per query the first n results with different entities, and only the kept columns."""
    first = F.row_number().over(Window.partitionBy(query, entity).orderBy(order))
    place = F.row_number().over(Window.partitionBy(query).orderBy(order))
    kept = results.withColumn("__f", first).where("__f = 1").withColumn("place", place).where(F.col("place") <= n)
    return kept.select(query, "place", *keep)


def without_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """The table without columns of these names, inside structs too."""
    out = []
    for field in df.schema.fields:
        if field.name in names:
            continue
        inner = [n for n in names if hasattr(field.dataType, "names") and n in field.dataType.names]
        out.append(F.col(field.name).dropFields(*inner).alias(field.name) if inner else F.col(field.name))
    return df.select(*out)


def golden_answers(df: DataFrame) -> Column:
    """Answers as a string array, from the first place that has any: extra_info.golden_answers,
    reward_model.ground_truth, extra_info.answer."""
    tries = []
    names = {f.name: getattr(f.dataType, "names", []) for f in df.schema.fields}
    for outer, inner, is_list in (("extra_info", "golden_answers", True), ("reward_model", "ground_truth", True), ("extra_info", "answer", False)):
        if inner in names.get(outer, []):
            v = F.col(f"{outer}.{inner}")
            tries.append(F.when(F.size(v) > 0, F.transform(v, lambda x: x.cast("string"))) if is_list else F.when(v.isNotNull(), F.array(v.cast("string"))))
    return F.coalesce(*tries, F.array().cast("array<string>"))


def scope_error(df: DataFrame, loaded: dict[str, str]) -> Column:
    """Why an edit does not belong to what is loaded; null if it does. A blank field is no claim."""
    return F.coalesce(*(F.when(~blank(k) & (F.col(k) != v), F.lit(f"{k} is not loaded")) for k, v in loaded.items() if k in df.columns), F.lit(None).cast("string"))


def protected_violations(paths: list[str], protected: list[str]) -> list[str]:
    """Paths that are, or lie below, a protected one."""
    tidy = lambda p: p.replace("\\", "/").strip("/")
    return [p for p in paths if any(tidy(p) == tidy(q) or tidy(p).startswith(tidy(q) + "/") for q in protected)]


def changed_since(files: DataFrame, since: Column | str, modified: str = "modificationTime") -> DataFrame:
    return files.where(F.col(modified) > c(since))


def coerced_results(x: Column | str, coherence: float = 0.5) -> Column:
    """A response, a JSON list of strings or of objects, as structs knowledge and coherence."""
    objects = F.from_json(c(x), "array<struct<knowledge:string,coherence:double>>")
    strings = F.from_json(c(x), "array<string>")
    named = F.filter(objects, lambda o: o["knowledge"].isNotNull())
    plain = F.transform(strings, lambda s: F.struct(s.alias("knowledge"), F.lit(coherence).alias("coherence")))
    filled = F.transform(named, lambda o: F.struct(o["knowledge"].alias("knowledge"), F.coalesce(o["coherence"], F.lit(coherence)).alias("coherence")))
    return F.when(F.size(named) > 0, filled).otherwise(F.coalesce(plain, F.array().cast("array<struct<knowledge:string,coherence:double>>")))


def exploded_contents(df: DataFrame, column: str) -> DataFrame:
    """A row for every content of a string or JSON array of strings, blanks left out: column `content`."""
    listed = F.from_json(column, "array<string>")
    values = F.when(F.trim(column).startswith("[") & listed.isNotNull(), listed).otherwise(F.array(column))
    return df.withColumn("content", F.explode(values)).where(~blank("content"))


def json_kind(x: Column | str) -> Column:
    v = F.try_parse_json(c(x))
    return F.when(c(x).isNull() | v.isNull(), "invalid").otherwise(F.regexp_extract(F.lower(F.schema_of_variant(v)), "^[a-z]+", 0))


def csv_profile(df: DataFrame, roles: dict[str, list[str]], n: int = 3) -> dict:
    """Header, first rows, and columns whose names hint at a role."""
    tidy = lambda s: "".join(ch for ch in s.lower() if ch.isalnum())
    found = {role: [col for col in df.columns if any(h in tidy(col) for h in hints)] for role, hints in roles.items()}
    return {"columns": df.columns, "rows": [r.asDict() for r in df.limit(n).collect()], "roles": found}


def archive_profile(members: DataFrame, name: str = "member") -> DataFrame:
    """(suffix, n, bytes, first names) of archive members or of a directory listing."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    return members.groupBy(suffix.alias("suffix")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.slice(F.array_sort(F.collect_set(name)), 1, 5).alias("samples"))


def manifest_violations(manifest: Column | str, dataset: str, version: int = 1) -> Column:
    """Blockers of a subset manifest (JSON): version, dataset, status, counts."""
    m = F.from_json(c(manifest), "struct<version:int,dataset:string,status:string,requested:int,complete:int,images:int>")
    checks = [(m.isNull(), "not JSON"), (m["version"] != version, "version"), (m["dataset"] != dataset, "dataset"), (m["status"] != "complete", "status"), (m["complete"] < m["requested"], "subset incomplete"), (m["images"] < m["complete"], "images missing")]
    return F.array_compact(F.array(*(F.when(bad, F.lit(why)) for bad, why in checks)))


def backfilled(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Blank columns filled from others."""
    return df.withColumns({a: first_present(F.col(a), F.col(b)) for a, b in pairs.items()})


def csv_text(*columns: str) -> Column:
    return F.to_csv(F.struct(*columns))


def parsed_csv(x: Column | str, schema: str) -> Column:
    return F.from_csv(c(x), F.lit(schema))


def prompt(template: str, **values: Column) -> Column:
    """A template with {name} fields filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def embedding_id(prefix: str, x: Column | str) -> Column:
    return F.concat(F.lit(prefix + ":"), c(x).cast("string"))


def bare_id(x: Column | str) -> Column:
    return F.regexp_replace(c(x), "^[^:]*:", "")
