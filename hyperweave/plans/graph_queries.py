"""Queries over the hypergraph's tables and the key-value stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import kv, merges
from ..operators.components import components, largest_component
from .base import GRAPH, SYM, Catalogue, orders_graph, read_table

Q = Catalogue()


@Q("hypergraph_incidence", f"WITH {GRAPH} SELECT * FROM inc")
def incidence(spark, d):
    return orders_graph(spark, d)


@Q("node_degree", f"WITH {GRAPH}, {SYM} SELECT src AS node, count(*) AS degree FROM sym GROUP BY src")
def degree(spark, d):
    return G.node_degree(orders_graph(spark, d))


@Q("edge_degree", f"WITH {GRAPH}, {SYM}, deg AS (SELECT src AS node, count(*) AS n FROM sym GROUP BY src) SELECT hyperedge, entity, weight, a.n + b.n AS degree FROM inc JOIN deg a ON a.node = hyperedge JOIN deg b ON b.node = entity")
def edge_degree(spark, d):
    return G.edge_degree(orders_graph(spark, d))


def _customers(spark, d):
    return read_table(spark, d, "customer").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("node"))


@Q("node_edges", f"WITH {GRAPH}, {SYM} SELECT 'p' || c_custkey AS node, dst, weight FROM customer JOIN sym ON src = 'p' || c_custkey")
def node_edges(spark, d):
    return G.node_edges(orders_graph(spark, d), _customers(spark, d))


@Q("has_node", f"WITH {GRAPH} SELECT 'p' || c_custkey AS node, ('p' || c_custkey) IN (SELECT entity FROM inc) AS found FROM customer")
def has_node(spark, d):
    return G.has_node(orders_graph(spark, d).select(F.col("entity").alias("node")), _customers(spark, d))


@Q("has_edge", f"WITH {GRAPH}, a AS (SELECT 'p' || c_custkey AS a, 'o' || (c_custkey * 4) AS b FROM customer) SELECT a, b, EXISTS (SELECT 1 FROM inc WHERE entity = a AND hyperedge = b) AS found FROM a")
def has_edge(spark, d):
    c = read_table(spark, d, "customer")
    asked = c.select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("o"), (F.col("c_custkey") * 4).cast("string")).alias("b"))
    return G.has_edge(orders_graph(spark, d), asked)


@Q("get_edge", f"WITH {GRAPH} SELECT 'o' || o_orderkey AS hyperedge, 'p' || o_custkey AS entity, weight FROM orders LEFT JOIN inc ON hyperedge = 'o' || o_orderkey AND entity = 'p' || o_custkey")
def get_edge(spark, d):
    asked = read_table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hyperedge"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("entity"))
    return G.get_edge(orders_graph(spark, d), asked)


@Q("upsert_edges", f"WITH {GRAPH}, n AS (SELECT 'o' || o_orderkey AS hyperedge, 'p' || o_custkey AS entity, max(o_totalprice) AS weight FROM orders GROUP BY 1, 2) SELECT coalesce(n.hyperedge, inc.hyperedge) AS hyperedge, coalesce(n.entity, inc.entity) AS entity, coalesce(n.weight, inc.weight) AS weight FROM inc FULL JOIN n ON n.hyperedge = inc.hyperedge AND n.entity = inc.entity")
def upsert_edges(spark, d):
    new = read_table(spark, d, "orders").groupBy(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hyperedge"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("entity")).agg(F.max("o_totalprice").alias("weight"))
    return G.upsert_edges(orders_graph(spark, d), new)


@Q("delete_cascade", f"WITH {GRAPH} SELECT * FROM inc WHERE entity NOT IN (SELECT 'p' || c_custkey FROM customer WHERE c_acctbal < 0) AND hyperedge NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_cascade(spark, d):
    a = read_table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("node"))
    b = read_table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return G.delete_nodes(orders_graph(spark, d), a.unionByName(b))


@Q("rename_hyperedges", f"WITH {GRAPH}, r AS (SELECT 'o' || o_orderkey AS old, 'o' || (o_orderkey - o_orderkey % 3) AS new FROM orders WHERE o_orderkey % 3 = 1), m AS (SELECT coalesce(new, hyperedge) AS hyperedge, entity, weight, CASE WHEN new IS NULL THEN 0 ELSE 1 END AS k FROM inc LEFT JOIN r ON old = hyperedge) SELECT hyperedge, entity, arg_max(weight, k) AS weight FROM m GROUP BY 1, 2")
def rename(spark, d):
    o = read_table(spark, d, "orders").where("o_orderkey % 3 = 1")
    name = lambda e: F.concat(F.lit("o"), F.expr(e).cast("string"))
    return G.rename_hyperedges(orders_graph(spark, d), o.select(name("o_orderkey").alias("old"), name("o_orderkey - o_orderkey % 3").alias("new")))


@Q("sync_weights", f"WITH {GRAPH} SELECT hyperedge, entity, coalesce(o_totalprice, weight) AS weight FROM inc LEFT JOIN (SELECT 'o' || o_orderkey AS h, o_totalprice FROM orders WHERE o_orderstatus = 'F') ON h = hyperedge")
def sync_weights(spark, d):
    w = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("hyperedge"), F.col("o_totalprice").alias("new_weight"))
    return G.set_hyperedge_weights(orders_graph(spark, d), w)


@Q("graph_weight", f"WITH {GRAPH}, f AS (SELECT hyperedge, arg_min(weight, entity) AS w FROM inc GROUP BY 1), n AS (SELECT 'o' || o_orderkey AS h, o_totalprice FROM orders WHERE o_orderstatus = 'F') SELECT a.hyperedge, coalesce(o_totalprice, w, 1.0) AS weight FROM (SELECT 'o' || o_orderkey AS hyperedge FROM orders UNION ALL SELECT 'x' || c_custkey FROM customer) a LEFT JOIN n ON h = a.hyperedge LEFT JOIN f ON f.hyperedge = a.hyperedge")
def graph_weight(spark, d):
    o = read_table(spark, d, "orders").withColumn("h", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    asked = o.select(F.col("h").alias("hyperedge")).union(read_table(spark, d, "customer").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))))
    return G.graph_weight(asked, o.where("o_orderstatus = 'F'").select(F.col("h").alias("node"), F.col("o_totalprice").alias("weight")), orders_graph(spark, d), 1.0)


@Q("graph_statistics", f"WITH {GRAPH} SELECT count(DISTINCT hyperedge) AS hyperedges, count(DISTINCT entity) AS entities, count(*) AS edges, count(DISTINCT hyperedge) + count(DISTINCT entity) AS nodes FROM inc")
def statistics(spark, d):
    return G.statistics(orders_graph(spark, d))


@Q("sample_rows", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text FROM documents ORDER BY doc_id LIMIT 5")
def sample_rows(spark, d):
    return G.sample_rows(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@Q("all_nodes_with_text", "WITH n AS (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), '<SEP>') AS source_id FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, unnest(string_split(source_id, '<SEP>')) AS chunk FROM n) SELECT 'o' || l_orderkey AS node, string_agg(p_name, '<SEP>' ORDER BY chunk, p_name) AS content FROM x LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = chunk GROUP BY 1")
def nodes_with_text(spark, d):
    ids = F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), G.SEP)
    nodes = read_table(spark, d, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("node")).agg(ids.alias("source_id"))
    chunks = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("content"))
    return G.nodes_with_text(nodes, chunks)


@Q("all_edges_with_text", "SELECT CAST(l_partkey AS VARCHAR) AS source_id, 'o' || l_orderkey AS hyperedge, 'p' || l_partkey AS entity, l_linenumber, l_shipdate, p_name AS content FROM lineitem LEFT JOIN part ON p_partkey = l_partkey ORDER BY l_shipdate DESC, hyperedge, entity, l_linenumber LIMIT 200")
def edges_with_text(spark, d):
    e = read_table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("source_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("hyperedge"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity"), "l_linenumber", "l_shipdate")
    chunks = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("content"))
    return e.join(chunks.withColumnRenamed("id", "source_id"), "source_id", "left").orderBy(F.desc("l_shipdate"), "hyperedge", "entity", "l_linenumber").limit(200)


@Q("connected_component", "WITH RECURSIVE e AS (SELECT DISTINCT 'S' || (s_suppkey % 7) AS a, 'N' || s_nationkey AS b FROM supplier), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT x, x FROM s UNION SELECT s.y, r.m FROM r JOIN s ON s.x = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY 1")
def connected(spark, d):
    e = read_table(spark, d, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 7).cast("string")).alias("a"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("b"))
    return components(e, "a", "b")


@Q("connected_component_largest", "WITH RECURSIVE e AS (SELECT DISTINCT least('C' || c_custkey, 'K' || (c_custkey % 11)) AS a, greatest('C' || c_custkey, 'K' || (c_custkey % 11)) AS b FROM customer), s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT x, x FROM s UNION SELECT s.y, r.m FROM r JOIN s ON s.x = r.n), c AS (SELECT n, min(m) AS m FROM r GROUP BY 1), best AS (SELECT m FROM c GROUP BY m ORDER BY count(*) DESC, m LIMIT 1) SELECT a AS source, b AS target FROM e JOIN c ON n = a WHERE m IN (SELECT m FROM best)")
def largest(spark, d):
    c = read_table(spark, d, "customer")
    return largest_component(c.select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("a"), F.concat(F.lit("k"), (F.col("c_custkey") % 11).cast("string")).alias("b")), "a", "b")


_WALK = "w{0} AS (SELECT start, {0} AS step, dst AS node FROM w{1} JOIN deg ON deg.src = node JOIN pl ON pl.src = node AND pl.i = CAST('0x' || substr(md5('{2}:' || start), 1, 8) AS BIGINT) % n)"


@Q("random_walks", f"WITH {GRAPH}, {SYM}, sd AS (SELECT DISTINCT src, dst FROM sym), deg AS (SELECT src, count(*) AS n FROM sd GROUP BY 1), pl AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM sd), w0 AS (SELECT src AS start, 0 AS step, src AS node FROM deg), " + ", ".join(_WALK.format(k, k - 1, 42 + k) for k in (1, 2, 3)) + " SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3")
def walks(spark, d):
    return G.random_walks(orders_graph(spark, d), 3)


@Q("biased_walks")
def biased(spark, d):
    """Second-order walks over the whole graph; tests hold their steps against the weights."""
    return G.biased_walks(orders_graph(spark, d), 3, p=4.0, q=0.5, of=read_table(spark, d, "lineitem"))


@Q("cross_modal_nodes", "WITH x AS (SELECT doc_id, source AS image_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS title FROM documents), e AS (SELECT *, upper(coalesce(nullif(trim(title), ''), nullif(trim(image_id), ''), 'UNKNOWN')) AS ent FROM x) SELECT 'image:' || image_id AS node, 'image_anchor' AS role FROM e UNION SELECT 'entity:' || ent, 'entity' FROM e UNION SELECT 'text:' || doc_id, 'text_evidence' FROM e UNION SELECT 'sample:' || doc_id, 'sample_hyperedge' FROM e")
def cross_nodes(spark, d):
    return G.cross_modal(_modal(spark, d))[0]


@Q("cross_modal_edges", "WITH x AS (SELECT doc_id, source AS image_id, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END AS title FROM documents), e AS (SELECT *, upper(coalesce(nullif(trim(title), ''), nullif(trim(image_id), ''), 'UNKNOWN')) AS ent FROM x) SELECT 'sample:' || doc_id AS source, 'image:' || image_id AS target, 'grounds_image' AS relation FROM e UNION SELECT 'sample:' || doc_id, 'entity:' || ent, 'grounds_entity' FROM e UNION SELECT 'sample:' || doc_id, 'text:' || doc_id, 'grounds_text' FROM e")
def cross_edges(spark, d):
    return G.cross_modal(_modal(spark, d))[1]


def _modal(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("image_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("title"), F.col("text").alias("contents"))


@Q("link_table", "SELECT CAST(doc_id AS VARCHAR) AS source_id, lang AS target_id, 'language_of' AS relation FROM documents WHERE lang IS NOT NULL UNION ALL SELECT CAST(doc_id AS VARCHAR), source, 'source_of' FROM documents WHERE source IS NOT NULL")
def link_table(spark, d):
    return G.link_table(read_table(spark, d, "documents"), [("lang", "language_of"), ("source", "source_of")], "doc_id")


@Q("resolve_by_links", "WITH l AS (SELECT doc_id, lang AS t, 1 AS k FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source, 2 FROM documents WHERE doc_id % 3 = 0), b AS (SELECT doc_id, arg_max(t, k) AS t, max(k) AS k FROM l GROUP BY 1) SELECT t AS target_id, CAST(doc_id AS VARCHAR) AS id, CASE k WHEN 1 THEN 'language_of' ELSE 'source_of' END AS relation, k AS rank, upper(t) AS label FROM b")
def resolve_links(spark, d):
    docs = read_table(spark, d, "documents")
    links = G.link_table(docs.where("doc_id % 2 = 0"), [("lang", "language_of")], "doc_id").unionByName(G.link_table(docs.where("doc_id % 3 = 0"), [("source", "source_of")], "doc_id"))
    records = docs.select(F.col("lang").alias("id")).union(docs.select("source")).distinct().withColumn("label", F.upper("id"))
    return G.resolve_by_links(docs.select(F.col("doc_id").cast("string").alias("id")), links, records, ["language_of", "source_of"]).withColumn("rank", F.col("rank").cast("int"))


@Q("hyperedge_merge", "SELECT 'o' || l_orderkey AS name, sum(l_quantity) AS weight, list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))) AS sources FROM lineitem GROUP BY 1")
def hyperedge_merge(spark, d):
    m = read_table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("name"), F.col("l_quantity").alias("weight"), F.col("l_suppkey").cast("string").alias("source"))
    return merges.merge_hyperedges(m)


@Q("entity_merge", "WITH m AS (SELECT 'p' || l_partkey AS name, l_returnflag AS type, l_linestatus AS description, CAST(l_suppkey AS VARCHAR) AS source, l_orderkey * 10 + l_linenumber AS pos FROM lineitem), t AS (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, min(pos)) AS r FROM m GROUP BY 1, 2) SELECT m.name, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, list_sort(list_distinct(list(source))) AS sources, any_value(t.type) AS type FROM m JOIN t ON t.name = m.name AND r = 1 GROUP BY m.name")
def entity_merge(spark, d):
    m = read_table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("description"), F.col("l_suppkey").cast("string").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return merges.merge_entities(m)


@Q("incidence_merge", "SELECT 'o' || l_orderkey AS hyperedge, 'p' || l_partkey AS entity, sum(l_quantity) AS weight, list_sort(list_distinct(list(l_shipdate::DATE::VARCHAR))) AS sources FROM lineitem GROUP BY 1, 2")
def incidence_merge(spark, d):
    m = read_table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("hyperedge"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity"), F.col("l_quantity").alias("weight"), F.to_date("l_shipdate").cast("string").alias("source"))
    return merges.merge_incidence(m)


@Q("kv_get_by_ids", "SELECT c_custkey * 2 AS id, c_custkey AS pos, o_totalprice FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 2")
def get_by_ids(spark, d):
    ids = read_table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_custkey").alias("pos"))
    return kv.get_by_ids(read_table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), ids, fields=["o_totalprice"])


@Q("kv_missing_keys", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing(spark, d):
    return kv.missing_keys(read_table(spark, d, "customer").select(F.col("c_custkey").alias("id")), read_table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


def _versions(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_totalprice")
    old = kv.first_per_key(o.where("o_orderkey % 2 = 0"), ["id"], [F.col("o_orderkey")])
    return old, o.where("o_orderkey % 2 = 1")


_VERSIONS = "o AS (SELECT o_custkey AS id, o_orderkey, o_totalprice FROM orders), old AS (SELECT id, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM o WHERE o_orderkey % 2 = 0 GROUP BY id)"


@Q("upsert_first_wins", f"WITH {_VERSIONS} SELECT * FROM old UNION ALL SELECT id, min(o_orderkey), arg_min(o_totalprice, o_orderkey) FROM o WHERE o_orderkey % 2 = 1 AND id NOT IN (SELECT id FROM old) GROUP BY id")
def upsert_first(spark, d):
    return kv.upsert_first(*_versions(spark, d), order="o_orderkey")


@Q("upsert_last_wins", f"WITH {_VERSIONS}, new AS (SELECT id, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM o WHERE o_orderkey % 2 = 1 GROUP BY id) SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def upsert_last(spark, d):
    return kv.upsert_last(*_versions(spark, d), "id", "o_orderkey")


@Q("upsert_fields", f"WITH {_VERSIONS}, new AS (SELECT id, max(o_totalprice) AS o_totalprice FROM o WHERE o_orderkey % 2 = 1 GROUP BY id) SELECT coalesce(new.id, old.id) AS id, o_orderkey, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice FROM old FULL JOIN new USING (id)")
def upsert_fields(spark, d):
    old, new = _versions(spark, d)
    return kv.merge_fields(old, new.groupBy("id").agg(F.max("o_totalprice").alias("o_totalprice")), "id")


@Q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return kv.set_union(read_table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@Q("set_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0")
def set_difference(spark, d):
    return kv.set_difference(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), read_table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("k")))


@Q("ordered_distinct", "SELECT o_custkey, list(o_orderstatus ORDER BY f) AS statuses FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    return read_table(spark, d, "orders").groupBy("o_custkey").agg(kv.ordered_distinct("o_orderstatus", "o_orderkey").alias("statuses"))
