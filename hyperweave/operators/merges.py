"""Merging of extracted mentions, de-duplication, fingerprints and packing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .kv import first_per_key

SEP = "<SEP>"


def merge_hyperedges(mentions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """mentions: (name, weight, source). Weights add up, with what is stored; sources are sorted and distinct."""
    both = mentions.select("name", "weight", "source")
    if existing is not None:
        both = both.unionByName(existing.select("name", "weight", F.explode_outer("sources").alias("source")).withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("source"))).select("name", F.when(F.col("r") == 1, F.col("weight")).otherwise(0.0).alias("weight"), "source"))
    return both.groupBy("name").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("sources"))


def merge_entities(mentions: DataFrame) -> DataFrame:
    """mentions: (name, type, description, source, pos). Most frequent type, the first seen on ties; sorted distinct
    descriptions, joined; sorted distinct sources. The mentions are read once: by name and type, then by name."""
    types = mentions.where("name IS NOT NULL").groupBy("name", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.collect_set("description").alias("d"), F.collect_set("source").alias("s"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    best = F.min_by("type", F.struct(-F.col("n"), "first")).alias("type")
    return types.groupBy("name").agg(F.array_join(every("d"), SEP).alias("description"), every("s").alias("sources"), best)


def merge_incidence(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("hyperedge", "entity").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("source")).alias("sources"))


def distinct_contents(docs: DataFrame, text: str, pos: str, keep: Column | None = None) -> DataFrame:
    """First document of every trimmed content that is not blank (and passes `keep`)."""
    rows = docs.withColumn("__c", F.trim(text)).where("__c <> ''")
    return first_per_key(rows if keep is None else rows.where(keep), ["__c"], [F.col(pos)]).drop("__c")


def group_sections(docs: DataFrame, title: Column, section: Column, text: str, pos: str) -> DataFrame:
    """Distinct texts of a (title, section), in order, as one; its id is the start of their SHA-1."""
    rows = docs.select(title.alias("title"), section.alias("section"), F.col(text).alias("text"), F.col(pos).alias("pos"))
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]))
    out = rows.groupBy("title", "section").agg(F.array_join(parts, "\n\n").alias("contents"))
    return out.withColumn("id", F.substring(F.sha1(F.concat_ws("\n", "title", "section")), 1, 16))


def pack(docs: DataFrame, group: str, pos: str, text: str, target: int, joint: str = "\n\n") -> DataFrame:
    """Consecutive documents of a group together until the next would pass `target` characters: (group, pack, text).

    The fold looks at lengths alone; a group's rows stream through one task in order, and only bins are kept."""
    ship(docs.sparkSession)
    lengths = docs.select(group, pos, F.length(text).alias("n"))

    def bins(frames: Iterator):
        held, size, bin_no = None, 0, 0
        for frame in frames:
            out = []
            for g, n in zip(frame[group], frame["n"].fillna(0)):
                if g != held:
                    held, size, bin_no = g, n, 0
                elif size + len(joint) + n > target:
                    size, bin_no = n, bin_no + 1
                else:  # the first text of a pack may be empty, its joint counts all the same
                    size += len(joint) + n
                out.append(bin_no)
            yield frame[[group, pos]].assign(pack=out)

    kinds = ", ".join(f"`{x}` {docs.schema[x].dataType.simpleString()}" for x in (group, pos))
    placed = lengths.repartition(group).sortWithinPartitions(group, pos).mapInPandas(bins, f"{kinds}, pack int")
    joined = docs.join(placed, [group, pos])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    return joined.groupBy(group, "pack").agg(F.array_join(parts, joint).alias("text"))


def fingerprint(df: DataFrame, text: str) -> DataFrame:
    """One row: a digest of all contents, whatever their order. Each content's SHA-256, with its length, goes into sums
    that add up on the map side."""
    h = F.sha2(F.concat(F.length(text).cast("string"), F.lit(":"), F.col(text)), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    return df.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(":", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def carry_forward(records: DataFrame, group: list[str], pos: str, value: Column) -> Column:
    """The latest value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def unique_suffix(df: DataFrame, key: str, pos: str) -> DataFrame:
    """id, id_1, id_2 ... in order, for repeated ids."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1
    return df.withColumn("unique_id", F.when(k == 0, F.col(key).cast("string")).otherwise(F.concat_ws("_", F.col(key).cast("string"), k.cast("string"))))


def recent(mutations: DataFrame, seq: str, key: str, cap: int = 256) -> DataFrame:
    """The newest `cap` mutations, and of these the newest of each key, newest first: `place` from 1. The cap comes first."""
    newest = mutations.orderBy(F.desc(seq)).limit(cap)
    kept = first_per_key(newest, [key], [F.desc(seq)])
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc(seq))))


def content_lookup(store: DataFrame, content: Column, key: str, pos: str) -> DataFrame:
    """(content, id): the first id of every normalised content."""
    return store.select(content.alias("content"), key, pos).where("content <> ''").groupBy("content").agg(F.min_by(key, pos).alias(key))
