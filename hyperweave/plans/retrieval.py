"""Retrieval as single plans: branches, rank fusion, contract order, promotion, fallback and entity fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import symmetric
from ..operators.kv import first_per_key

#: Default sizes of the answers.
ENTITY_K, HYPEREDGE_K, RAG_K, LIBRARY_K = 5, 5, 10, 60
#: Recent mutations that are kept.
RING = 256
#: Weights of the three modalities, and of the route that treats them alike.
MIXED, EVEN = {"image": 0.2, "entity": 0.55, "hyperedge": 0.25}, {"image": 1.0, "entity": 1.0, "hyperedge": 1.0}


def _rank(partition: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order))


def entity_branch(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: (query, pos, node). One hop from known entities; an ordered pair counts at its first seed; by degree and
    weight, ties in discovery order: (query, i, knowledge) with i from 0."""
    asked = seeds.select(F.col("node").alias("entity")).distinct()
    touched = edges.join(asked, "entity", "left_semi")
    # degrees of what the seeds touch only: the entities' edges are all among the touched ones, the hyperedges' are not
    by_e = touched.groupBy("entity").agg(F.count("*").alias("d_e"))
    by_h = edges.join(touched.select("hyperedge").distinct(), "hyperedge", "left_semi").groupBy("hyperedge").agg(F.count("*").alias("d_h"))
    ranked = touched.join(by_h, "hyperedge").join(by_e, "entity").withColumn("degree", F.col("d_h") + F.col("d_e"))
    first = seeds.groupBy("query", "node").agg(F.min("pos").alias("pos"))
    hop = first.join(ranked, F.col("node") == F.col("entity")).select("query", "pos", "node", F.col("hyperedge").alias("knowledge"), "degree", "weight")
    return hop.select("query", (_rank(["query"], F.desc("degree"), F.desc("weight"), F.col("pos"), F.col("knowledge")) - 1).alias("i"), "knowledge")


def hyperedge_branch(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds: (query, pos, node); nodes: (hyperedge, weight). Known hyperedges by weight, ties in seed order."""
    found = seeds.join(nodes, F.col("node") == F.col("hyperedge"))
    return found.select("query", (_rank(["query"], F.desc("weight"), F.col("pos")) - 1).alias("i"), F.col("node").alias("knowledge"))


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = LIBRARY_K) -> DataFrame:
    """Sum of 1 / (i + 1) over every place in both lists; ties by first appearance, the first list before the second."""
    both = first.withColumn("list", F.lit(0)).unionByName(second.withColumn("list", F.lit(1)))
    fused = both.groupBy("query", "knowledge").agg(F.sum(1.0 / (F.col("i") + 1)).alias("score"), F.min(F.struct("list", "i")).alias("seen"))
    ranked = fused.withColumn("rank", _rank(["query"], F.desc("score"), F.col("seen")))
    return ranked.where(F.col("rank") <= k).select("query", "knowledge", "score", "rank", F.bround("score", 3).alias("coherence"))


def hybrid_query(edges: DataFrame, nodes: DataFrame, entity_seeds: DataFrame, hyperedge_seeds: DataFrame, k: int = LIBRARY_K, mode: str = "hybrid") -> DataFrame:
    """The two branches, fused. Queries without any match give no rows."""
    if mode != "hybrid":
        raise ValueError(f"mode {mode!r} is not supported; use 'hybrid'")
    return reciprocal_rank_fusion(entity_branch(edges, entity_seeds), hyperedge_branch(nodes, hyperedge_seeds), k)


def token_budget(df: DataFrame, partition: list[str], order: list[Column], tokens: str, most: int) -> DataFrame:
    """The longest prefix whose token counts add up to at most `most`."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__sum", F.sum(tokens).over(w)).where(F.col("__sum") <= most).drop("__sum")


def text_units_from_entities(edges: DataFrame, sources: DataFrame, seeds: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """sources: (node, chunk). Chunks of the seeds, by seed order and by how many one-hop neighbours share the chunk. How many
    share it is counted once for each node and chunk, whichever and however many queries ask for the node."""
    asked = sources.join(seeds.select("node").distinct(), "node", "left_semi").select("node", "chunk")
    hop = symmetric(edges).select(F.col("src").alias("node"), F.col("dst").alias("other"))
    beside = hop.join(seeds.select("node").distinct(), "node", "left_semi").join(sources.select(F.col("node").alias("other"), "chunk"), "other")
    # a node's own chunks (without other) and those of its neighbours meet in one grouping; a chunk counts where it is the node's own
    both = asked.select("node", "chunk", F.lit(None).cast(hop.schema["other"].dataType).alias("other")).unionByName(beside.select("node", "chunk", "other"))
    both = both.repartition("node", "chunk").groupBy("node", "chunk", "other").agg(F.lit(1).alias("one"))
    counts = both.groupBy("node", "chunk").agg(F.count("other").alias("relations"), F.bool_or(F.col("other").isNull()).alias("own")).where("own").drop("own")
    units = seeds.join(counts.join(chunks, "chunk"), "node").repartition("query")
    others = [c for c in chunks.columns if c != "chunk"]
    units = units.groupBy("query", "chunk").agg(F.min("pos").alias("pos"), F.max("relations").alias("relations"), *(F.first(c).alias(c) for c in others))
    return token_budget(units, ["query"], [F.col("pos"), F.desc("relations"), F.col("chunk")], "tokens", most).select("chunk", "query", "pos", "relations", *others)


def entities_from_hyperedges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct entities next to the seeds, by degree."""
    degree = edges.groupBy("entity").agg(F.count("*").alias("degree"))
    found = seeds.join(edges, F.col("node") == F.col("hyperedge")).groupBy("query", "entity").agg(F.min("pos").alias("pos"))
    return found.join(degree, "entity").select("query", "entity", "degree", _rank(["query"], F.desc("degree"), F.col("pos"), F.col("entity")).alias("rank"))


def text_units_from_hyperedges(sources: DataFrame, seeds: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    units = seeds.join(sources, "node").groupBy("query", "chunk").agg(F.min("pos").alias("pos")).join(chunks, "chunk")
    return token_budget(units, ["query"], [F.col("pos"), F.col("chunk")], "tokens", most)


def contract_sort(results: DataFrame, partition: list[str]) -> DataFrame:
    """Active before deleted, then by coherence, then by weight, then in the given order: a column `rank`."""
    return results.withColumn("rank", _rank(partition, F.col("active").cast("int").desc(), F.desc("coherence"), F.desc("weight"), F.col("pos")))


def with_state(results: DataFrame, state: DataFrame) -> DataFrame:
    """Results with active and weight of their content; unknown content is active with weight 1; an active record beats a deleted one."""
    best = first_per_key(state, ["content"], [F.desc(F.col("active").cast("int")), F.desc("weight")])
    return results.join(best.select("content", "active", "weight"), "content", "left").fillna({"active": True, "weight": 1.0})


def promote_recent(matches: DataFrame, recent: DataFrame, searchable: DataFrame) -> DataFrame:
    """matches: (query, pos, content); recent: (seq, content, active), the greater seq the newer; searchable: (content).

    Recent contents equal to the query, then those that contain it or lie in it (queries of 12 characters or more), go
    before the matches, the newest first; each content once. The ring of recent mutations holds RING rows, the bound of what is broadcast. A query without searchable contents, or a blank one, keeps its matches.
    """
    q = matches.select("query").distinct().withColumn("q", F.expr("lower(regexp_replace(trim(query), '\\\\s+', ' '))")).where("q <> ''")
    recent = recent.orderBy(F.desc("seq")).limit(RING)
    known = recent.join(searchable, "content", "left_semi").withColumn("c", F.expr("lower(regexp_replace(trim(content), '\\\\s+', ' '))"))
    equal = q.join(known.where("active"), F.col("q") == F.col("c")).select("query", F.lit(0).alias("tier"), (-F.col("seq")).alias("pos"), "content")
    near = q.join(F.broadcast(known), (F.col("q") == F.col("c")) | ((F.length("q") >= 12) & (F.col("c").contains(F.col("q")) | F.col("q").contains(F.col("c"))))).select("query", F.lit(1).alias("tier"), (-F.col("seq")).alias("pos"), "content")
    every = equal.unionByName(near).unionByName(matches.select("query", F.lit(2).alias("tier"), "pos", "content"))
    every = first_per_key(every, ["query", "content"], [F.col("tier"), F.col("pos")])
    return every.select("query", "content", _rank(["query"], F.col("tier"), F.col("pos")).alias("rank"))


def match_fallback(hyperedges: DataFrame, entities: DataFrame) -> DataFrame:
    """Without a graph: 1 / (place + 1) over the hyperedge list, the entity list going on from its end; a repeated name counts at its first place."""
    n = hyperedges.groupBy("query").agg(F.count("*").alias("n"))
    rest = entities.join(n, "query", "left").select("query", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "name")
    both = first_per_key(hyperedges.select("query", "pos", "name").unionByName(rest), ["query", "name"], [F.col("pos")])
    return both.select("query", "name", "pos", (1.0 / (F.col("pos") + 1)).alias("coherence"))


def fresh_merge(matched: DataFrame, graph: DataFrame) -> DataFrame:
    """Matched contents at coherence 1 first, then graph results that are not among them."""
    first = first_per_key(matched, ["query", "content"], [F.col("pos")]).select("query", F.lit(0).alias("tier"), "pos", "content", F.lit(1.0).alias("coherence"))
    every = first.unionByName(graph.select("query", F.lit(1).alias("tier"), "pos", "content", "coherence"))
    every = first_per_key(every, ["query", "content"], [F.col("tier"), F.col("pos")])
    return every.select("query", "content", "coherence", (_rank(["query"], F.col("tier"), F.col("pos")) - 1).alias("pos"))


def best_per_url(hits: DataFrame) -> DataFrame:
    """(query, modality, url, score): the best hit of every url."""
    return hits.groupBy("query", "modality", "url").agg(F.max("score").alias("score"))


def entity_fusion(hits: DataFrame, weights: dict[str, float] = MIXED) -> DataFrame:
    """Weighted sum over the modalities of a url's best score, by score and url, with the confidence against the best."""
    w = F.create_map(*(F.lit(x) for p in weights.items() for x in p))
    fused = best_per_url(hits).groupBy("query", "url").agg(
        F.sum(F.try_element_at(w, F.col("modality")) * F.col("score")).alias("score"),
        F.array_sort(F.collect_set("modality")).alias("sources"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "score")))).alias("by_source"),
    )
    top = F.max("score").over(Window.partitionBy("query"))
    confidence = F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") / top))).otherwise(0.0)
    return fused.withColumn("confidence", confidence).withColumn("rank", _rank(["query"], F.desc("score"), F.col("url")))


def related_hyperedges(candidates: DataFrame, k: int, least: float = 0.45) -> DataFrame:
    """candidates: (query, url, text, score). Distinct texts of a url with a score of at least `least`: the best k."""
    kept = first_per_key(candidates.where(F.col("score") >= least), ["query", "url", "text"], [F.desc("score")])
    return kept.withColumn("rank", _rank(["query", "url"], F.desc("score"), F.col("text"))).where(F.col("rank") <= k)


def merge_related(candidates: DataFrame, k: int) -> DataFrame:
    """Over all urls of a query: distinct texts by score, the best k."""
    kept = first_per_key(candidates, ["query", "text"], [F.desc("score"), F.col("url")])
    return kept.withColumn("rank", _rank(["query"], F.desc("score"), F.col("text"))).where(F.col("rank") <= k)


def route(queries: DataFrame) -> DataFrame:
    """queries: (query, image_id, context). Where a query goes: visual_entity, fused, image or text."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    where = F.when(F.trim("query") == "<img>", F.when(blank("image_id"), "invalid").otherwise("visual_entity")).when(~blank("query") & ~blank("image_id"), "fused").when(blank("query") & ~blank("image_id"), "image").when(~blank("query"), "text").otherwise("invalid")
    return queries.withColumn("route", where)
