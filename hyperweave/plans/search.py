"""Composite searches: text retrieval over a graph, and retrieval by route over text, image and entity vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectors import top_k
from . import retrieval as R


def text_search(queries: DataFrame, encode: Callable, entity_vectors: DataFrame, hyperedge_vectors: DataFrame, edges: DataFrame, nodes: DataFrame, state: DataFrame, recent: DataFrame | None = None, entity_k: int = R.ENTITY_K, hyperedge_k: int = R.HYPEREDGE_K, rag_k: int = R.RAG_K) -> DataFrame:
    """queries: (query). Encodes them, finds entities and hyperedges, promotes recent ones, queries the graph, puts
    fresh matches first and orders by the contract: (query, content, coherence, active, weight, rank)."""
    asked = queries.select("query", encode(F.col("query")).alias("embedding"))
    seeds = lambda v, k: top_k(v, asked, k).select("query", (F.col("rank") - 1).alias("pos"), F.col("id").alias("node"))
    e, h = seeds(entity_vectors, entity_k), seeds(hyperedge_vectors, hyperedge_k)
    matched = h.select("query", "pos", F.col("node").alias("content"))
    if recent is not None:
        matched = R.promote_recent(matched, recent, state.select("content")).select("query", (F.col("rank") - 1).alias("pos"), "content")
        h = matched.select("query", "pos", F.col("content").alias("node"))
    graph = R.hybrid_query(edges, nodes, e, h, rag_k).select("query", (F.col("rank") - 1).alias("pos"), F.col("knowledge").alias("content"), "coherence")
    merged = R.fresh_merge(matched, graph)
    return R.contract_sort(R.with_state(merged, state), ["query"]).select("query", "content", "coherence", "active", "weight", "rank")


def without_graph(queries: DataFrame, encode: Callable, entity_vectors: DataFrame, hyperedge_vectors: DataFrame, k: int = R.RAG_K) -> DataFrame:
    """The same question answered by matches alone."""
    asked = queries.select("query", encode(F.col("query")).alias("embedding"))
    found = lambda v: top_k(v, asked, k).select("query", (F.col("rank") - 1).alias("pos"), F.col("id").alias("name"))
    return R.match_fallback(found(hyperedge_vectors), found(entity_vectors)).where(F.col("pos") < k)


def routed_search(queries: DataFrame, indexes: dict[str, DataFrame], vectors: DataFrame, k: int = 20) -> DataFrame:
    """queries: (query, image_id, context, id); vectors: (id, modality, embedding) of the queries; indexes by modality
    with (id, url, embedding). Text asks the entity and hyperedge indexes, an image its own, a fused query all; an
    image-only question asks all with one vector and equal weights: (query, url, score, rank, route)."""
    routed = R.route(queries)
    asks = {"text": ["entity", "hyperedge"], "image": ["image"], "fused": ["image", "entity", "hyperedge"], "visual_entity": ["image", "entity", "hyperedge"]}
    hits = None
    for modality, index in indexes.items():
        routes = [r for r, ms in asks.items() if modality in ms]
        mine = routed.where(F.col("route").isin(routes)).join(vectors.where(F.col("modality") == modality).select("id", "embedding"), "id")
        found = top_k(index, mine.select(F.col("id").alias("query"), "embedding"), k).join(index.select("id", "url"), "id")
        found = found.select(F.col("query").alias("id"), F.lit(modality).alias("modality"), "url", "score")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.join(routed.select("id", "route"), "id").withColumnRenamed("id", "query")
    mixed = R.entity_fusion(hits.where("route <> 'visual_entity'").drop("route"))
    even = R.entity_fusion(hits.where("route = 'visual_entity'").drop("route"), R.EVEN)
    return mixed.unionByName(even).join(routed.select(F.col("id").alias("query"), "route"), "query").select("query", "url", "score", "rank", "route")


#: Modality, index and store of the two graph indexes, in the order of their answers (fixed values of the contract).
GRAPH_INDEXES = (("bge_entity", "kv_store_entities.json"), ("bge_hyperedge", "kv_store_hyperedges.json"))


def graph_corpora(entities: DataFrame, hyperedges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity corpus, hyperedge corpus), each (id, content): what is embedded, and under which text it is found.

    entities: (entity_name, content); an entity is found by its name and embedded by its content, by its name where that is
    blank; blank names are left out. hyperedges: (content, hyperedge_name, deleted); deleted and blank ones are left out, and the
    name stands in for a missing content. Equal texts are one."""
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    named = entities.where(~blank(F.col("entity_name"))).select(F.col("entity_name").alias("id"), F.when(blank(F.col("content")), F.col("entity_name")).otherwise(F.col("content")).alias("content"))
    text = F.when(F.coalesce(F.col("content"), F.lit("")) == "", F.col("hyperedge_name")).otherwise(F.col("content"))
    live = hyperedges.where(~F.coalesce(F.col("deleted"), F.lit(False))).select(text.alias("content")).where(~blank(F.col("content")))
    return named.groupBy("id").agg(F.min("content").alias("content")), live.distinct().select(F.col("content").alias("id"), "content")


def graph_search(asked: DataFrame, entity_index: DataFrame, hyperedge_index: DataFrame, entity_k: int = R.ENTITY_K, hyperedge_k: int = R.HYPEREDGE_K, context: Callable[[DataFrame, DataFrame], DataFrame] | None = None, dataset: str = "", subset: str = "") -> DataFrame:
    """asked: (query, embedding); indexes: (id, embedding), id the text that is found. (query, place, modality, id, knowledge,
    coherence, score, provenance): the nearest of both indexes by inner product, entities first.

    context: (entity hits, hyperedge hits) -> rows of the same columns; a query that has such rows gets them instead."""
    found = []
    for (modality, store), index, k in zip(GRAPH_INDEXES, (entity_index, hyperedge_index), (entity_k, hyperedge_k)):
        if k <= 0:
            continue
        rank = F.col("rank") - 1
        provenance = F.struct(F.lit(dataset).alias("dataset"), F.lit(subset).alias("subset"), F.lit(modality).alias("index"), rank.alias("rank"), F.col("id").cast("string").alias("embedding_id"), F.lit(store).alias("store_path"))
        hits = top_k(index, asked, k)
        found.append(hits.select("query", (rank + (entity_k if found else 0)).alias("place"), F.lit(modality).alias("modality"), "id", F.col("id").alias("knowledge"), F.col("score").alias("coherence"), "score", provenance.alias("provenance")))
    if not found:
        raise ValueError("one of the indexes must be asked for at least one hit")
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if context is None:
        return out
    more = context(*(out.where(F.col("modality") == m) for m, _ in GRAPH_INDEXES))
    return out.join(more.select("query").distinct(), "query", "left_anti").unionByName(more.select(*out.columns))
