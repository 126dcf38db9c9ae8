"""Joins with fallback keys, uniqueness guards, resolution rules and fuzzy conditions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compact, query_key
from .kv import first_per_key
from .partition import numbered


def spread_join(left: DataFrame, right: DataFrame, on: str, row: str, spread: int = 16) -> DataFrame:
    """Inner join on a key of few values: the left's rows are dealt over `spread` parts of each key by `row`, the right's go to all."""
    part = F.pmod(F.xxhash64(row), F.lit(spread)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    return left.withColumn("__part", part).join(right.withColumn("__part", every), [on, "__part"]).drop("__part")


#: The right's rows in one list of paired_join, and the pairs that the rows of one part make with a list.
LIST, PAIRS = 1 << 12, 1 << 24


def paired_join(left: DataFrame, right: DataFrame, on: str, row: str, spread: int) -> DataFrame:
    """Inner join on a key whose pairs are far more than its rows, dealt by pairs: the right's rows lie in lists of at most
    LIST, the left's rows of a key in `spread` parts by `row`, or more where a part would make over PAIRS pairs with a list.
    A list meets one part in one place and is unfolded there, so a task holds one list at a time and nothing is broadcast.
    Tasks are as many as pairs demand, since the rows that make them are too few to tell. Up to PAIRS pairs are one task's
    work and joined plainly."""
    n = left.groupBy(on).agg(F.count("*").alias("__l")).join(right.groupBy(on).agg(F.count("*").alias("__r")), on)
    pairs = n.agg(F.sum(F.col("__l").cast("double") * F.col("__r"))).first()[0] or 0
    if pairs <= PAIRS:
        return spread_join(left, right, on, row, spread)
    most = F.ceil(F.col("__l") * F.least(F.col("__r"), F.lit(LIST)) / PAIRS)
    sizes = n.select(on, F.ceil(F.col("__r") / LIST).alias("__blocks"), F.greatest(F.least(F.lit(spread), "__l"), most).alias("__parts"))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / (4 * PAIRS)))
    below = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    dealt, others = [on, "__block", "__part"], [c for c in right.columns if c != on]
    parts = left.join(sizes, on).withColumn("__part", F.pmod(F.xxhash64(row), F.col("__parts"))).withColumn("__block", below("__blocks"))
    # a list's place comes from its rows alone; where many are equal, their block has more lists than one
    place = F.xxhash64(*right.columns)
    blocks = right.join(sizes, on).withColumn("__place", place).withColumn("__block", F.pmod("__place", F.col("__blocks")))
    blocks = blocks.withColumn("__i", F.floor((F.row_number().over(Window.partitionBy(on, "__block").orderBy("__place", *others)) - 1) / LIST))
    lists = blocks.groupBy(on, "__block", "__parts", "__i").agg(F.collect_list(F.struct(*others)).alias("__list"))
    lists = lists.select(on, "__block", below("__parts").alias("__part"), "__list").repartition(tasks, *dealt).hint("merge")
    return parts.repartition(tasks, *dealt).join(lists, dealt).select(*left.columns, F.inline("__list"))


def fallback_join(build: DataFrame, probe: DataFrame, first: str, second: str, row: str, spread: int = 1) -> DataFrame:
    """All matches on the first key; rows without any are matched on the second. match_key says which. row: the probe's id.
    spread: parts that each key's probe rows are dealt over at least, where keys are few and have many rows (paired_join)."""
    sides = [build.select(F.col(k).alias("__k"), *[F.col(x).alias(f"b_{x}") for x in build.columns]) for k in (first, second)]
    return _fallback(sides, probe, first, second, row, spread)


def fallback_counts(build: DataFrame, probe: DataFrame, first: str, second: str, row: str) -> DataFrame:
    """The probe's matched rows with match_key and n, the number of their matches in fallback_join, none of which are made."""
    sides = [build.groupBy(F.col(k).alias("__k")).agg(F.count("*").alias("n")) for k in (first, second)]
    return _fallback(sides, probe, first, second, row, 1)


def _fallback(sides: list[DataFrame], probe: DataFrame, first: str, second: str, row: str, spread: int) -> DataFrame:
    def on(rows: DataFrame, key: str, side: DataFrame) -> DataFrame:
        keyed = rows.withColumn("__k", F.col(key))
        return (paired_join(keyed, side, "__k", row, spread) if spread > 1 else keyed.join(side, "__k")).drop("__k").withColumn("match_key", F.lit(key))

    met = probe.join(sides[0].select("__k").distinct(), F.col(first) == F.col("__k"), "left_semi").select(row).distinct()
    return on(probe, first, sides[0]).unionByName(on(probe.join(met, row, "left_anti"), second, sides[1]))


def left_prefer(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Left outer join; of columns that both have, the left's value where it is not null."""
    other = right.select(on, *(F.col(x).alias(f"__{x}") for x in right.columns if x != on))
    both = left.join(other, on, "left")
    mine = [F.coalesce(x, f"__{x}").alias(x) if f"__{x}" in other.columns else F.col(x) for x in left.columns]
    return both.select(*mine, *(F.col(f"__{x}").alias(x) for x in right.columns if x not in left.columns))


def unambiguous(candidates: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """One row for each key all of whose candidates have the same signature."""
    grouped = candidates.groupBy(*keys).agg(F.count_distinct(F.struct(*signature)).alias("n"), F.min(F.struct(*signature)).alias("s"))
    return grouped.where("n = 1").select(*keys, "s.*")


def first_file_wins(mappings: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(mappings, [key], [F.col(order)])


def resolve_paths(rows: DataFrame, candidates: Column, listing: DataFrame, row: str, path: str = "path") -> DataFrame:
    """(row, path): the first of the row's candidate paths that is in the listing; null without one."""
    tried = rows.select(row, F.posexplode(candidates).alias("__pos", path))
    found = tried.join(listing.select(path).distinct(), path, "left_semi").groupBy(row).agg(F.min_by(path, "__pos").alias(path))
    return rows.select(row).join(found, row, "left")


def substring_resolve(asked: DataFrame, stored: DataFrame, least: int = 10, ratio: float = 0.5) -> DataFrame:
    """asked: (ask, text); stored: (id, pos, content). (ask, id, how): exact match by normalised content, earliest first;
    else, for texts of `least` characters or more, the stored content that contains it with the greatest length ratio
    of at least `ratio`, earliest on ties. Containment is an equi-join: a text that is contained has its first `least`
    characters among the content's substrings of that length; what meets there is verified."""
    a = asked.withColumn("t", query_key("text"))
    s = stored.withColumn("c", query_key("content"))
    exact = a.join(first_per_key(s, ["c"], [F.col("pos")]), F.col("t") == F.col("c")).select("ask", "id", F.lit("exact").alias("how"))
    rest = a.join(exact.select("ask"), "ask", "left_anti").where(F.length("t") >= least)
    share = F.length("t") / F.length("c")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("c") - (least - 1)), lambda i: F.col("c").substr(i, F.lit(least))))
    # only ids travel with the grams; the texts join what the asked grams leave
    asked_grams = rest.select(F.substring("t", 1, least).alias("g")).distinct()
    met = s.where(F.length("c") >= least).select("id", "pos", F.explode(grams).alias("g")).join(asked_grams, "g", "left_semi")
    met = rest.withColumn("g", F.substring("t", 1, least)).join(met, "g").drop("g")
    near = met.join(s.select("id", "pos", "c"), ["id", "pos"]).where(F.contains("c", F.col("t")) & (share >= ratio)).withColumn("share", share)
    near = first_per_key(near, ["ask"], [F.desc("share"), F.col("pos")]).select("ask", "id", F.lit("contains").alias("how"))
    return exact.unionByName(near)


def jaccard_best(asked: DataFrame, stored: DataFrame, least: float = 0.8) -> DataFrame:
    """asked: (ask, text); stored: (id, pos, content). The stored text with the greatest Jaccard similarity of words, if at
    least `least`; earliest on ties. Candidates share one of their rarest words: of n words, the first
    n - ceil(least * n) + 1 in the order of frequency; they are verified on all words."""
    words = lambda d, k, t: d.select(k, F.explode(F.array_distinct(F.filter(F.split(query_key(t), " "), lambda w: w != ""))).alias("w"))
    a, s = words(asked, "ask", "text"), words(stored.withColumn("key", F.struct("pos", "id")), "key", "content")
    common = a.select("w").unionByName(s.select("w")).groupBy("w").agg(F.count("*").alias("f"))

    def ordered(d: DataFrame, k: str) -> DataFrame:
        rows = d.join(common, "w").groupBy(k).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias(f"w_{k}"))
        n = F.size(f"w_{k}")
        return rows.withColumn("p", F.explode(F.slice(f"w_{k}", 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)))

    met = ordered(a, "ask").join(ordered(s, "key"), "p").drop("p").distinct()
    both = F.size(F.array_intersect("w_ask", "w_key"))
    scored = met.withColumn("jaccard", both / (F.size("w_ask") + F.size("w_key") - both)).where(F.col("jaccard") >= least)
    return first_per_key(scored, ["ask"], [F.desc("jaccard"), F.col("key")]).select("ask", "key.id", "jaccard")


def answer_section(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages: (page, sections array); answers: (page, aliases array). The first section, and in it the first alias, whose
    compacted text holds the alias between word boundaries: (page, section, alias)."""
    s = pages.select("page", F.posexplode("sections").alias("section", "text"))
    a = answers.select("page", F.posexplode("aliases").alias("k", "alias"))
    pad = lambda x: F.concat(F.lit(" "), compact(x), F.lit(" "))
    hit = s.join(a, "page").where((compact("alias") != "") & F.contains(pad("text"), pad("alias")))
    return first_per_key(hit, ["page"], [F.col("section"), F.col("k")]).select("page", "section", "alias")


def fan_out(hits: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """sidecar: (key, urls array, titles array): a row for each url, its title beside it."""
    return hits.join(sidecar, key).withColumn("x", F.explode(F.arrays_zip("urls", "titles"))).select(*hits.columns, F.col("x.urls").alias("url"), F.col("x.titles").alias("title"))


def zip_union(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Columns of both for the same rows; a column of both must agree, else the query fails."""
    shared = [x for x in right.columns if x in left.columns and x != row]
    other = right.select(row, *(F.col(x).alias(f"__{x}") if x in shared else F.col(x) for x in right.columns if x != row))
    both = left.join(other, row)
    for x in shared:
        both = both.withColumn(x, F.when(F.col(x).eqNullSafe(F.col(f"__{x}")), F.col(x)).otherwise(F.raise_error(F.lit(f"conflicting {x}")))).drop(f"__{x}")
    return both


def broadcast_args(rows: DataFrame, args: DataFrame, row: str) -> DataFrame:
    """args: (pos, ...). A single row of arguments goes with every row; else the i-th with the i-th."""
    if len(args.limit(2).collect()) == 1:
        return rows.crossJoin(F.broadcast(args.drop("pos").limit(1)))
    return rows.join(args.withColumnRenamed("pos", row), row, "left")


def scatter(batch: DataFrame, active: DataFrame, row: str, value: str, fill: object) -> DataFrame:
    """The i-th active result goes to the i-th active row; the others get the fill."""
    order = numbered(batch.where("active").select(row), row, into="i").withColumn("i", F.col("i") + 1)
    return batch.join(order.join(active, "i").select(row, value), row, "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def selected_mapping(mapping: DataFrame, selected: DataFrame, key: str, path: str, pos: str) -> DataFrame:
    """In the order of selection: path of each id that has exactly one, and why the others have none."""
    kept = mapping.join(selected.select(key), key, "left_semi").groupBy(key).agg(F.count_distinct(path).alias("n"), F.min(path).alias(path))
    out = selected.join(kept, key, "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "conflict").otherwise("ok")
    return out.withColumn("status", status).withColumn(path, F.when(F.col("status") == "ok", F.col(path))).drop("n").orderBy(pos)


def expected_metadata(assets: DataFrame, checksums: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each field by precedence: checksum list, manifest, catalogue."""
    a = checksums.select(key, *(F.col(f).alias(f"__a_{f}") for f in fields))
    b = manifest.select(key, *(F.col(f).alias(f"__b_{f}") for f in fields))
    joined = assets.join(a, key, "left").join(b, key, "left")
    return joined.select(*[x for x in assets.columns if x not in fields], *(F.coalesce(f"__a_{f}", f"__b_{f}", f).alias(f) for f in fields))
