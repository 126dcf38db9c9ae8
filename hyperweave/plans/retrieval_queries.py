"""Queries of the retrieval plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import spread
from . import retrieval as R
from .base import GRAPH, Catalogue, orders_graph, read_table

Q = Catalogue()


def _seeds(spark, d):
    """Every customer is a query with five parts and five orders as seeds."""
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos"))
    e = c.select("query", "pos", F.concat(F.lit("p"), (F.col("query") * 3 + F.col("pos")).cast("string")).alias("node"))
    h = c.select("query", "pos", F.concat(F.lit("o"), (F.col("query") * 7 + F.col("pos")).cast("string")).alias("node"))
    return e, h


_SEEDS = "c AS (SELECT c_custkey AS query, unnest(range(5)) AS pos FROM customer), es AS (SELECT query, pos, 'p' || (query * 3 + pos) AS node FROM c), hs AS (SELECT query, pos, 'o' || (query * 7 + pos) AS node FROM c)"
_HYBRID = f"""WITH {GRAPH}, {_SEEDS}, dh AS (SELECT hyperedge, count(*) AS n, sum(weight) AS w FROM inc GROUP BY 1), de AS (SELECT entity, count(*) AS n FROM inc GROUP BY 1),
b1 AS (SELECT query, inc.hyperedge AS k, row_number() OVER (PARTITION BY query ORDER BY dh.n + de.n DESC, inc.weight DESC, pos, inc.hyperedge) - 1 AS i FROM es JOIN inc ON entity = node JOIN dh USING (hyperedge) JOIN de USING (entity)),
b2 AS (SELECT query, node AS k, row_number() OVER (PARTITION BY query ORDER BY w DESC, pos) - 1 AS i FROM hs JOIN dh ON hyperedge = node),
u AS (SELECT query, k, i, 0 AS l FROM b1 UNION ALL SELECT query, k, i, 1 FROM b2),
f AS (SELECT query, k, sum(1.0::DOUBLE / (i + 1)) AS score, min((l * 1000000 + i)) AS seen FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, seen) AS rank FROM f)"""


def _hybrid(spark, d, k):
    g = orders_graph(spark, d)
    nodes = g.groupBy("hyperedge").agg(F.sum("weight").alias("weight"))
    e, h = _seeds(spark, d)
    return R.hybrid_query(g, nodes, e, h, k)


@Q("kg_hybrid_query", f"{_HYBRID} SELECT query, k AS knowledge, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def kg_hybrid(spark, d):
    return _rounded(_hybrid(spark, d, R.RAG_K).drop("coherence"))


@Q("entity_branch", f"{_HYBRID} SELECT query, CAST(i AS INT) AS i, k AS knowledge FROM b1")
def entity_branch(spark, d):
    return R.entity_branch(orders_graph(spark, d), _seeds(spark, d)[0])


@Q("hyperedge_branch", f"{_HYBRID} SELECT query, CAST(i AS INT) AS i, k AS knowledge FROM b2")
def hyperedge_branch(spark, d):
    nodes = orders_graph(spark, d).groupBy("hyperedge").agg(F.sum("weight").alias("weight"))
    return R.hyperedge_branch(nodes, _seeds(spark, d)[1])


_SOURCES = "src AS (SELECT DISTINCT 'p' || l_partkey AS node, 's' || l_suppkey AS chunk FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem), ch AS (SELECT 's' || s_suppkey AS chunk, 100 + s_suppkey % 50 AS tokens FROM supplier)"


def _sources(spark, d):
    li = read_table(spark, d, "lineitem")
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("chunk")
    src = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"), s).union(li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), s))
    src = spread(src, "node", of=src).distinct()
    chunks = read_table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("chunk"), (F.col("s_suppkey") % 50 + 100).alias("tokens"))
    return src, chunks


@Q("text_units_from_entities", f"""WITH {GRAPH}, {_SEEDS}, {_SOURCES}, own AS (SELECT query, pos, node, chunk FROM es JOIN src USING (node)),
cnt AS (SELECT query, own.node, own.chunk, count(DISTINCT hyperedge) AS relations FROM own JOIN inc ON entity = own.node JOIN src s ON s.node = hyperedge AND s.chunk = own.chunk GROUP BY 1, 2, 3),
u AS (SELECT query, chunk, min(pos) AS pos, max(coalesce(relations, 0)) AS relations FROM own LEFT JOIN cnt USING (query, node, chunk) GROUP BY 1, 2),
t AS (SELECT u.*, tokens, sum(tokens) OVER (PARTITION BY query ORDER BY pos, relations DESC, chunk ROWS UNBOUNDED PRECEDING) AS s FROM u JOIN ch USING (chunk))
SELECT chunk, query, CAST(pos AS INT) AS pos, relations, tokens FROM t WHERE s <= 1000""")
def units_entities(spark, d):
    src, chunks = _sources(spark, d)
    return R.text_units_from_entities(orders_graph(spark, d), src, _seeds(spark, d)[0], chunks, 1000)


@Q("entities_from_hyperedges", f"WITH {GRAPH}, {_SEEDS}, de AS (SELECT entity, count(*) AS degree FROM inc GROUP BY 1), f AS (SELECT query, entity, min(pos) AS pos FROM hs JOIN inc ON hyperedge = node GROUP BY 1, 2) SELECT query, entity, degree, CAST(row_number() OVER (PARTITION BY query ORDER BY degree DESC, pos, entity) AS INT) AS rank FROM f JOIN de USING (entity)")
def entities_hyperedges(spark, d):
    return R.entities_from_hyperedges(orders_graph(spark, d), _seeds(spark, d)[1])


@Q("text_units_from_hyperedges", f"WITH {_SEEDS}, {_SOURCES}, u AS (SELECT query, chunk, min(pos) AS pos FROM hs JOIN src USING (node) GROUP BY 1, 2), t AS (SELECT u.*, tokens, sum(tokens) OVER (PARTITION BY query ORDER BY pos, chunk ROWS UNBOUNDED PRECEDING) AS s FROM u JOIN ch USING (chunk)) SELECT chunk, query, CAST(pos AS INT) AS pos, tokens FROM t WHERE s <= 1000")
def units_hyperedges(spark, d):
    src, chunks = _sources(spark, d)
    return R.text_units_from_hyperedges(src, _seeds(spark, d)[1], chunks, 1000)


def _vectors(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return e, e.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding")


_DOT = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


def _top(measure: str, k: int, least: str = "", over: int = 1) -> str:
    inner = f"SELECT q.vec_id AS query, e.vec_id AS id, {measure} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0"
    if over > 1:
        return f"WITH s AS ({inner}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM s), t AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM r WHERE r <= {over * k} AND score >= {least}) SELECT query, id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank <= {k}"
    return f"WITH s AS ({inner}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s {f'WHERE score >= {least}' if least else ''}) SELECT query, id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k}"


def _rounded(df):
    return df.withColumn("score", F.round("score", 9))


@Q("vector_topk_ip", _top(_DOT, 10))
def topk_ip(spark, d):
    return _rounded(V.top_k(*_vectors(spark, d), 10))


@Q("vector_topk_cosine", _top(_COS, 5, "0.2"))
def topk_cosine(spark, d):
    e, q = _vectors(spark, d)
    return _rounded(V.top_k(e, q, 5, measure="cosine", least=0.2))


@Q("vector_radius", _top(_COS, 1000, "0.2"))
def radius(spark, d):
    e, q = _vectors(spark, d)
    return _rounded(V.top_k(e, q, 1000, measure="cosine", least=0.2))


@Q("vector_overfetch", _top(_COS, 5, "0.25", 2))
def overfetch(spark, d):
    e, q = _vectors(spark, d)
    return _rounded(V.top_k(e, q, 5, measure="cosine", least=0.25, over=2))


@Q("vector_index_check", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(min(len(embedding)) AS INT) AS low, CAST(max(len(embedding)) AS INT) AS high, CAST([] AS VARCHAR[]) AS blockers FROM embeddings")
def index_check(spark, d):
    return V.check_index(_vectors(spark, d)[0], dimension=64)


@Q("vector_truncate", "WITH t AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 16) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM t) SELECT vec_id, round(v[1] / n, 9) AS first, round(v[16] / n, 9) AS last, CAST(len(v) AS INT) AS size FROM n")
def truncate(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", V.truncated("embedding", 16).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[15], 9).alias("last"), F.size("v").alias("size"))


@Q("vector_quantise", "WITH t AS (SELECT vec_id, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi, embedding[1]::DOUBLE AS x FROM embeddings) SELECT vec_id, CAST(round_even((x - lo) * 255 / (hi - lo), 0) AS INT) AS code FROM t")
def quantise(spark, d):
    v = read_table(spark, d, "embeddings").select("vec_id", V.quantised(F.transform("embedding", lambda x: x.cast("double"))).alias("q"))
    return v.select("vec_id", F.col("q.codes")[0].alias("code"))


def _hits(spark, d):
    e, q = _vectors(spark, d)
    top = V.top_k(e, q, 30).join(e.select("id", "label"), "id")
    kind = F.element_at(F.array(F.lit("image"), F.lit("entity"), F.lit("hyperedge")), (F.col("id") % 3 + 1).cast("int"))
    return top.select("query", "id", kind.alias("modality"), F.concat(F.lit("u"), F.col("label").cast("string")).alias("url"), "score")


_HITS = f"s AS (SELECT q.vec_id AS query, e.vec_id AS id, e.label, {_DOT} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM s) WHERE r <= 30), hits AS (SELECT query, id, ['image', 'entity', 'hyperedge'][id % 3 + 1] AS modality, 'u' || label AS url, score FROM tk), best AS (SELECT query, modality, url, max(score) AS score FROM hits GROUP BY 1, 2, 3)"


@Q("entity_fusion", f"WITH {_HITS}, f AS (SELECT query, url, sum(score * CASE modality WHEN 'image' THEN 0.2 WHEN 'entity' THEN 0.55 ELSE 0.25 END) AS score FROM best GROUP BY 1, 2), g AS (SELECT *, max(score) OVER (PARTITION BY query) AS top FROM f) SELECT query, url, round(score, 9) AS score, round(CASE WHEN top > 0 THEN greatest(0, least(1, score / top)) ELSE 0 END, 9) AS confidence, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, url) AS INT) AS rank FROM g")
def fusion(spark, d):
    return R.entity_fusion(_hits(spark, d)).select("query", "url", F.round("score", 9).alias("score"), F.round("confidence", 9).alias("confidence"), "rank")


@Q("visual_entity", f"WITH {_HITS}, f AS (SELECT query, url, sum(score) AS score FROM best GROUP BY 1, 2), g AS (SELECT query, url, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, url) AS rank FROM f) SELECT query, url, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM g WHERE rank <= 5")
def visual(spark, d):
    return R.entity_fusion(_hits(spark, d), R.EVEN).where("rank <= 5").select("query", "url", F.round("score", 9).alias("score"), "rank")


@Q("related_hyperedges", f"WITH {_HITS}, k AS (SELECT query, url, 't' || (id % 7) AS text, max(score) AS score FROM hits WHERE score >= 0.2 GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query, url ORDER BY score DESC, text) AS rank FROM k) SELECT query, url, text, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def related(spark, d):
    c = _hits(spark, d).select("query", "url", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"), "score")
    return _rounded(R.related_hyperedges(c, 3, 0.2))


@Q("merge_related", f"WITH {_HITS}, k AS (SELECT query, 't' || (id % 7) AS text, max(score) AS score FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, text) AS rank FROM k) SELECT query, text, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4")
def merged(spark, d):
    c = _hits(spark, d).select("query", "url", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"), "score")
    return _rounded(R.merge_related(c, 4)).drop("url")


@Q("search_contract_sort", "SELECT user_id, event_id AS pos, event_type <> 'error' AS active, floor(value / 10) AS coherence, value AS weight, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END DESC, floor(value / 10) DESC, value DESC, event_id) AS INT) AS rank FROM events")
def contract(spark, d):
    e = read_table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), (F.col("event_type") != "error").alias("active"), F.floor(F.col("value") / 10).cast("double").alias("coherence"), F.col("value").alias("weight"))
    return R.contract_sort(e, ["user_id"])


@Q("match_fallback", "WITH n AS (SELECT c_custkey % 10 AS query, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) - 1 AS pos, 'n' || c_nationkey AS name FROM customer), m AS (SELECT c_custkey % 10 AS query, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) - 1 AS pos, 'n' || (c_nationkey + 10) AS name FROM customer), k AS (SELECT query, count(*) AS c FROM n GROUP BY 1), u AS (SELECT * FROM n UNION ALL SELECT m.query, pos + c, name FROM m JOIN k USING (query)) SELECT query, name, min(pos) AS pos, 1.0::DOUBLE / (min(pos) + 1) AS coherence FROM u GROUP BY 1, 2")
def fallback(spark, d):
    from pyspark.sql import Window

    c = read_table(spark, d, "customer").withColumn("query", F.col("c_custkey") % 10)
    c = c.withColumn("pos", (F.row_number().over(Window.partitionBy("query").orderBy("c_custkey")) - 1).cast("long"))
    name = lambda k: F.concat(F.lit("n"), (F.col("c_nationkey") + k).cast("string")).alias("name")
    return R.match_fallback(c.select("query", "pos", name(0)), c.select("query", "pos", name(10)))


@Q("fresh_merge", "WITH g AS (SELECT c_nationkey AS query, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, c_mktsegment AS content, c_acctbal AS coherence FROM customer), m AS (SELECT n_nationkey AS query, 0 AS pos, 'BUILDING' AS content FROM nation), u AS (SELECT query, 0 AS t, pos, content, 1.0::DOUBLE AS coherence FROM m UNION ALL SELECT query, 1, pos, content, coherence FROM g), f AS (SELECT query, content, arg_min(coherence, t * 1000000 + pos) AS coherence, min(t * 1000000 + pos) AS o FROM u GROUP BY 1, 2) SELECT query, content, coherence, CAST(row_number() OVER (PARTITION BY query ORDER BY o) - 1 AS INT) AS pos FROM f")
def fresh(spark, d):
    from pyspark.sql import Window

    c = read_table(spark, d, "customer")
    g = c.select(F.col("c_nationkey").alias("query"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("pos"), F.col("c_mktsegment").alias("content"), F.col("c_acctbal").alias("coherence"))
    m = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), F.lit(0).alias("pos"), F.lit("BUILDING").alias("content"))
    return R.fresh_merge(m, g)


@Q("promote_recent", r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS content FROM benchmark), q AS (SELECT DISTINCT content AS query FROM b WHERE content <> ''),
m AS (SELECT query, 2 AS tier, 0 AS pos, 'match a' AS content FROM q UNION ALL SELECT query, 2, 1, 'match b' FROM q), r AS (SELECT * FROM b ORDER BY item_id DESC LIMIT 256),
n AS (SELECT query, CASE WHEN lower(content) = lower(query) THEN 0 ELSE 1 END AS tier, -item_id AS pos, content FROM q JOIN r ON lower(content) = lower(query) OR (length(query) >= 12 AND (contains(lower(content), lower(query)) OR contains(lower(query), lower(content))))),
f AS (SELECT query, content, min(struct_pack(t := tier, p := pos)) AS o FROM (SELECT * FROM n UNION ALL SELECT * FROM m) GROUP BY 1, 2)
SELECT query, content, CAST(row_number() OVER (PARTITION BY query ORDER BY o) AS INT) AS rank FROM f""")
def promote(spark, d):
    b = read_table(spark, d, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("content"))
    q = b.where("content <> ''").select(F.col("content").alias("query"))
    m = q.withColumn("pos", F.lit(0)).withColumn("content", F.lit("match a")).unionByName(q.withColumn("pos", F.lit(1)).withColumn("content", F.lit("match b")))
    recent = b.select(F.col("item_id").alias("seq"), "content", F.lit(True).alias("active"))
    return R.promote_recent(m, recent, b.select("content"))


@Q("route_queries", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND turn % 2 = 0 THEN 'visual_entity' WHEN turn % 3 = 0 THEN 'invalid' WHEN turn % 2 = 0 THEN 'fused' ELSE 'text' END AS route FROM conversations")
def route(spark, d):
    c = read_table(spark, d, "conversations")
    q = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "<img>").otherwise("words").alias("query"), F.when(F.col("turn") % 2 == 0, "img1").alias("image_id"))
    return R.route(q).select("conv_id", "turn", "route")


@Q("incremental_reindex", "WITH o AS (SELECT vec_id AS pos, md5('c' || (vec_id % 40)) AS h, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS k FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT vec_id AS pos, md5('c' || (vec_id % 45)) AS h, row_number() OVER (PARTITION BY vec_id % 45 ORDER BY vec_id) AS k FROM embeddings) SELECT n.pos, o.pos IS NOT NULL AS reused FROM n LEFT JOIN o ON o.h = n.h AND o.k = n.k")
def incremental(spark, d):
    e = read_table(spark, d, "embeddings")
    name = lambda k: F.concat(F.lit("c"), (F.col("vec_id") % k).cast("string")).alias("content")
    old = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("pos"), name(40), "embedding")
    return V.reindex(e.select(F.col("vec_id").alias("pos"), name(45)), old, V.hash_encoder(64)).select("pos", "reused")


@Q("graph_search", "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, CASE WHEN c.label < 5 THEN 'bge_entity' ELSE 'bge_hyperedge' END AS modality, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query, modality ORDER BY s DESC, id) - 1 AS r FROM s) SELECT query, CAST(r + CASE WHEN modality = 'bge_entity' THEN 0 ELSE 5 END AS INT) AS place, modality, id, round(s, 6) AS score FROM r WHERE r < 5")
def graph_search(spark, d):
    """Queries against two indexes, entities and hyperedges, with where each hit comes from."""
    from .search import graph_search as search

    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    asked = e.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding")
    found = search(asked, e.where("label < 5"), e.where("label >= 5"), 5, 5)
    return found.select("query", "place", "modality", "id", F.round("score", 6).alias("score"))
