"""Graph construction: documents to chunks, extracted records, and merged tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, document_id, md5_id, number_or, split_on, token_chunks
from ..operators.kv import first_per_key, missing_keys
from ..operators.merges import merge_entities, merge_hyperedges, merge_incidence

#: What parts the records of an extraction, and their fields.
FIELD, RECORD, DONE = "<|>", "##", "<|COMPLETE|>"
ENTITY_WEIGHT, HYPEREDGE_WEIGHT = 50.0, 1.0
MARK = "<hyperedge>"


def parse_records(responses: DataFrame, chunk: str = "chunk", text: str = "response") -> DataFrame:
    """(chunk, pos, kind, name, type, description, weight, hyperedge): the records of each response, in order.

    A record is what stands between the outermost parentheses of a line. Blank fields are dropped before they are
    counted. Hyper-relations are tested first; an entity belongs to the latest hyper-relation and is dropped without one.
    A response is cut at its hyper-relations while it is still one row, so its records are neither dealt nor sorted.
    """
    at = lambda f, k: F.try_element_at(f, F.lit(k))
    is_h = lambda f: (F.size(f) >= 3) & (at(f, 1) == '"hyper-relation"')
    is_e = lambda f: (F.size(f) >= 5) & (at(f, 1) == '"entity"')
    bodies = F.transform(split_on(text, [RECORD, DONE]), lambda r, i: F.struct(i.alias("pos"), F.regexp_extract(r, r"\((.*)\)", 1).alias("body")))
    fields = F.transform(F.filter(bodies, lambda x: x["body"] != ""), lambda x: F.struct(x["pos"].alias("pos"), split_on(x["body"], [FIELD]).alias("f")))
    rows = responses.select(chunk, F.filter(fields, lambda x: is_h(x["f"]) | is_e(x["f"])).alias("r"))
    rows = rows.withColumn("first", F.filter(F.transform("r", lambda x, i: F.when(is_h(x["f"]), i + 1)), lambda p: p.isNotNull()))
    stop = lambda i: F.coalesce(F.try_element_at("first", i + 2), F.size("r") + 1)
    groups = F.transform("first", lambda p, i: F.struct(at(F.try_element_at("r", p)["f"], 2).alias("own"), F.slice("r", p, stop(i) - p).alias("items")))
    groups = rows.select(chunk, F.explode(groups).alias("g")).select(chunk, F.concat(F.lit(MARK), clean(F.col("g.own"))).alias("hyperedge"), F.col("g.items").alias("items"))
    kinds = groups.select(chunk, "hyperedge", F.explode("items").alias("x")).select(chunk, "hyperedge", "x.pos", "x.f")
    kinds = kinds.withColumn("kind", F.when(is_h(F.col("f")), "hyperedge").otherwise("entity"))
    at, name = (lambda k: F.try_element_at("f", F.lit(k))), clean(F.try_element_at("f", F.lit(2)))
    return kinds.select(
        chunk,
        "pos",
        "kind",
        F.when(F.col("kind") == "hyperedge", F.col("hyperedge")).otherwise(F.upper(name)).alias("name"),
        F.when(F.col("kind") == "entity", F.upper(clean(at(3)))).alias("type"),
        F.when(F.col("kind") == "entity", clean(at(4))).alias("description"),
        F.when(F.col("kind") == "entity", number_or(at(5), ENTITY_WEIGHT)).otherwise(number_or(at(3), HYPEREDGE_WEIGHT)).alias("weight"),
        "hyperedge",
    ).where("kind = 'hyperedge' OR trim(name) <> ''")


def offline_extractor(text: Column) -> Column:
    """A deterministic extraction response: every sentence is a hyper-relation, its words in capitals or of nine letters
    and more are entities."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]\s+|\n"), lambda v: F.trim(v)), lambda s: F.length(s) > 0)

    def one(s: Column) -> Column:
        words = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(\p{Lu}[\p{L}]+|[\p{L}]{9,})"), F.lit(1)))
        entities = F.transform(words, lambda w: F.concat(F.lit(f'("entity"{FIELD}'), w, F.lit(f"{FIELD}term{FIELD}"), w, F.lit(f"{FIELD}1)")))
        tidy = F.translate(s, "()", "")
        return F.array_join(F.concat(F.array(F.concat(F.lit(f'("hyper-relation"{FIELD}'), tidy, F.lit(f"{FIELD}1)"))), entities), RECORD)

    return F.array_join(F.transform(sentences, one), RECORD)


def insert_documents(docs: DataFrame, text: str, known_docs: DataFrame | None = None, known_chunks: DataFrame | None = None, extract: Callable[[Column], Column] = offline_extractor, most: int = 768, overlap: int = 64) -> dict[str, DataFrame]:
    """New documents as tables: full_docs, chunks, hyperedges, entities, incidence, and the two key-value stores."""
    rows = docs.select(document_id(text).alias("id"), F.trim(text).alias("content")).where("content <> ''")
    if known_docs is not None:
        rows = rows.join(missing_keys(rows, known_docs), "id", "left_semi")
    full = rows.distinct()
    cut = lambda d: token_chunks(d, "id", "content", most, overlap).select(md5_id("chunk-", "content").alias("chunk"), F.col("id").alias("full_doc_id"), "chunk_order_index", "tokens", "content")
    chunks = first_per_key(cut(full), ["chunk"], [F.col("full_doc_id"), F.col("chunk_order_index")])
    # the same texts, whichever documents hold them: these are dealt once, and not sorted
    texts = cut(rows).select("chunk", "content").distinct()
    if known_chunks is not None:
        chunks, texts = (t.join(known_chunks.select("chunk"), "chunk", "left_anti") for t in (chunks, texts))
    records = parse_records(texts.select("chunk", extract(F.col("content")).alias("response")))
    order = F.concat_ws(":", "chunk", F.lpad(F.col("pos").cast("string"), 9, "0"))
    mentions = records.withColumn("order", order)
    hyperedges = merge_hyperedges(mentions.where("kind = 'hyperedge'").select("name", "weight", F.col("chunk").alias("source")))
    own = mentions.where("kind = 'entity'")
    entities = merge_entities(own.select("name", "type", "description", F.col("chunk").alias("source"), F.col("order").alias("pos")))
    incidence = merge_incidence(own.select("hyperedge", F.col("name").alias("entity"), "weight", F.col("chunk").alias("source")))
    return {
        "full_docs": full,
        "chunks": chunks,
        "hyperedges": hyperedges,
        "entities": entities,
        "incidence": incidence,
        "hyperedges_kv": hyperedges.select(md5_id("rel-", "name").alias("id"), F.col("name").alias("content"), F.col("name").alias("hyperedge_name")),
        "entities_kv": entities.select(md5_id("ent-", "name").alias("id"), F.concat("name", "description").alias("content"), F.col("name").alias("entity_name")),
    }


def insert_custom(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """A given graph: chunks (source_id, content), entities (name, type, description, source_id), relations (source, target,
    description, weight, source_id). Unknown sources, types and ends become UNKNOWN."""
    known = chunks.select("source_id", md5_id("chunk-", F.trim("content")).alias("chunk"))
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    nodes = entities.join(known, "source_id", "left").select(F.upper("name").alias("node"), unknown("type").alias("type"), "description", unknown("chunk").alias("source"))
    edges = relations.join(known, "source_id", "left").select(F.upper("source").alias("source"), F.upper("target").alias("target"), "description", F.coalesce("weight", F.lit(1.0)).alias("weight"), unknown("chunk").alias("chunk"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().join(nodes, "node", "left_anti")
    filler = ends.select("node", F.lit("UNKNOWN").alias("type"), F.lit("UNKNOWN").alias("description"), F.lit("UNKNOWN").alias("source"))
    return {"nodes": nodes.unionByName(filler), "edges": edges.withColumn("id", md5_id("rel-", F.concat("source", "target")))}
