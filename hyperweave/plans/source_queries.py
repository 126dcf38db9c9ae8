"""Queries of the sources and sinks: tables that go out in a format and are read back from it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import tokens
from ..session import scratch
from ..sources import archives, files, graphml, stores, tables
from ..streaming import salvage
from ..streaming.versions import Versions
from .base import GRAPH, Catalogue, orders_graph, read_table

Q = Catalogue()

#: Folder of the public vocabulary files; a parameter, since they are not part of the repository.
TOKENIZERS = os.environ.get("HYPERWEAVE_TOKENIZERS", "/opt/tokenizers")


@Q("tar_members", "SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS digest FROM pages")
def tar_members(spark, d):
    """Pages as members of TARs, one for each partition, found by their headers and read by ranges."""
    pages = read_table(spark, d, "pages").select(F.format_string("pages/%d.html", "page_id").alias("member"), "html")
    found = archives.index(spark, *archives.paths_of(archives.write_tar(pages, "member", "html")))
    key = F.regexp_extract("member", r"(\d+)\.html$", 1).cast("long")
    return archives.read_members(found).select(key.alias("page_id"), F.col("size").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


@Q("zip_pages", "SELECT page_id, url, sha256(coalesce(html, '')) AS digest FROM pages")
def zip_pages(spark, d):
    """A knowledge base of pages by key in deflated ZIP members, streamed item by item and joined with the keys wanted."""
    pages = read_table(spark, d, "pages").select(F.col("page_id").cast("string").alias("key"), "url", "html")
    items = pages.select("key", F.to_json(F.struct("url", F.coalesce("html", F.lit("")).alias("html"))).alias("page"))
    found = archives.index(spark, *archives.paths_of(archives.write_json_zip(items, "key", "page")))
    wanted = pages.select("key")
    page = F.from_json("value", "url string, html string")
    return archives.read_json_items(found, wanted).select(F.col("key").cast("long").alias("page_id"), page.alias("p")).select("page_id", "p.url", F.sha2("p.html", 256).alias("digest"))


@Q("graphml_scan", f"WITH {GRAPH} SELECT 'edge' AS kind, hyperedge AS source, entity AS target, CAST(weight AS DOUBLE) AS weight, NULL AS role FROM inc UNION ALL SELECT DISTINCT 'node', hyperedge, NULL, NULL, 'hyper & edge' FROM inc UNION ALL SELECT DISTINCT 'node', entity, NULL, NULL, 'entity' FROM inc")
def graphml_scan(spark, d):
    inc = orders_graph(spark, d)
    # roles differ, so either side is made distinct by itself; orders lie where they were grouped
    nodes = inc.select(F.col("hyperedge").alias("node"), F.lit("hyper & edge").alias("role")).distinct().union(inc.select("entity", F.lit("entity")).distinct())
    path = scratch(spark, "graph")
    files.write_graphml(nodes.select("node", F.create_map(F.lit("role"), "role").alias("data")), inc.select(F.col("hyperedge").alias("source"), F.col("entity").alias("target"), F.col("weight").cast("double").alias("weight"), F.lit(None).cast("map<string,string>").alias("data")), path)
    found = graphml.read_elements(spark, path, split=1 << 20)
    return found.select("kind", "source", "target", "weight", F.when(F.col("kind") == "node", F.col("data")["role"]).alias("role"))


@Q("node_link_json", f"WITH {GRAPH} SELECT 'edge' AS kind, hyperedge AS a, entity AS b FROM inc UNION ALL SELECT DISTINCT 'node', hyperedge, NULL FROM inc UNION ALL SELECT DISTINCT 'node', entity, NULL FROM inc")
def node_link_json(spark, d):
    """The graph as JSON objects of nodes and edges, written as lines and read back."""
    inc = orders_graph(spark, d)
    nodes = inc.select(F.col("hyperedge").alias("node")).union(inc.select("entity")).distinct().withColumn("data", F.create_map().cast("map<string,string>"))
    path = scratch(spark, "json")
    lines = graphml.to_node_link(nodes, inc.select(F.col("hyperedge").alias("source"), F.col("entity").alias("target"), "weight", F.create_map().cast("map<string,string>").alias("data")))
    for kind in ("node", "edge"):  # each to its own folder: with partitionBy, a task sorts its lines by kind first
        lines.where(F.col("kind") == kind).select("value").write.text(f"{path}/kind={kind}")
    back = spark.read.text(path).select("kind", F.from_json("value", "id string, source string, target string").alias("x"))
    return back.select("kind", F.coalesce("x.id", "x.source").alias("a"), F.col("x.target").alias("b"))


@Q("csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '\"' || c_mktsegment || '\"' AS label, CAST(NULL AS VARCHAR) AS missing, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def csv_scan(spark, d):
    """Rows with quotes and line breaks, written in the order of a header that knows a column more and one less."""
    path = scratch(spark, "csv")
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.concat("c_name", F.lit('\n"'), "c_mktsegment", F.lit('"')).alias("label"))
    files.write_csv(c, path, ["c_custkey", "label", "missing"])
    return files.read_csv(spark, path)


@Q("json_lines_scan", "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def json_lines_scan(spark, d):
    path = scratch(spark, "lines")
    files.write_json_lines(read_table(spark, d, "conversations"), path)
    return files.read_json_lines(spark, path, "conv_id long, turn long, role string, text string")


@Q("split_scan", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'train' WHEN 'P' THEN 'dev' ELSE 'test' END AS split, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS split_order FROM orders")
def split_scan(spark, d):
    path, orders = scratch(spark, "splits"), read_table(spark, d, "orders")
    names = {"train": "O", "dev": "P", "test": "F"}
    for split, status in names.items():
        orders.where(F.col("o_orderstatus") == status).select("o_orderkey").write.parquet(f"{path}/{split}")
    return files.read_splits(spark, {s: f"{path}/{s}" for s in names})


@Q("vector_index_scan", "SELECT vec_id, embedding[1] AS first, CAST(len(embedding) AS INTEGER) AS width, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS count, 0 AS n_blockers FROM embeddings")
def vector_index_scan(spark, d):
    """A checked index, written with its metadata and loaded through the gate that compares both."""
    path, e = scratch(spark, "index"), read_table(spark, d, "embeddings").select("vec_id", "embedding")
    info = tables.write_index(e, path, {"encoder": "given"}, key="vec_id")
    vectors, blockers = tables.load_index(spark, path, info["count"])
    return vectors.select("vec_id", F.col("embedding")[0].alias("first"), F.size("embedding").alias("width"), F.lit(info["count"]).cast("long").alias("count"), F.lit(len(blockers)).alias("n_blockers"))


@Q("version_restore", "SELECT n_nationkey, n_name, v FROM nation, (VALUES (0), (1), (0)) t(v)")
def version_restore(spark, d):
    """Two versions, the second refused by a check once and then taken, then the first restored: what a reader sees each time."""
    held, n = Versions(spark, scratch(spark, "versions")), read_table(spark, d, "nation").select("n_nationkey", "n_name")
    held.commit({"nation": n.withColumn("v", F.lit(0))})
    seen = [held.read("nation")]
    try:
        held.commit({"nation": n.withColumn("v", F.lit(9))}, check=lambda *_: ["refused"])
    except ValueError:
        pass
    held.commit({"nation": n.withColumn("v", F.lit(1))})
    seen.append(held.read("nation"))
    held.restore(0)
    return seen[0].unionByName(seen[1]).unionByName(held.read("nation"))


@Q("kv_store_merge", "SELECT 'c' || c_custkey AS id, c_name AS name, CAST(n AS BIGINT) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def kv_store_merge(spark, d):
    """Customers put into a store that is not there yet, a second insert that changes nothing, and a field laid over some."""
    path = scratch(spark, "store").removeprefix("file://") + ".db"
    stores.register(spark)
    orders = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = read_table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_name")
    laid = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.to_json(F.struct("orders")).alias("value"))
    for rows, merge in ((c.select("id", F.to_json(F.struct(F.col("c_name").alias("name"))).alias("value")), "insert"), (c.select("id", F.lit("{}").alias("value")), "insert"), (laid, "fields")):
        rows.write.format("kv_store").options(path=path, table="customers", merge=merge).mode("append").save()
    back = spark.read.format("kv_store").options(path=path, table="customers").load()
    return back.select("id", F.from_json("value", "name string, orders long").alias("v")).select("id", "v.name", "v.orders")


@Q("token_windows")
def token_windows(spark, d):
    """Whole documents in windows of 768 tokens that overlap by 64; tests hold them against the tokenizer by hand."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return tokens.token_windows(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken").select("doc_id", "chunk_order_index", "tokens", "start", "end", "text")


@Q("cache_salvage", "SELECT 'q' || (event_id % 311) AS query_key, arg_max('Q ' || event_type, event_id) AS original, arg_max('r' || event_id, event_id) AS result, max(event_id) AS created, max(event_id) AS updated, max(event_id % 7) AS hit_count FROM events GROUP BY 1")
def cache_salvage(spark, d):
    """A cache's log with every line once whole and once torn, the torn ones with the next line behind them."""
    e = read_table(spark, d, "events")
    key = F.concat(F.lit("q"), (F.col("event_id") % 311).cast("string"))
    seq = F.col("event_id").cast("long")
    rows = e.select(key.alias("query_key"), F.concat(F.lit("Q "), "event_type").alias("original"), F.concat(F.lit("r"), seq.cast("string")).alias("result"), seq.alias("created"), seq.alias("updated"), (seq % 7).alias("hit_count"))
    path, whole = scratch(spark, "cache"), salvage.lines(rows)
    whole.select(F.concat(F.expr("substring(value, 1, length(value) - 1 - abs(hash(value)) % 40)"), "value").alias("value")).write.text(path)
    return salvage.read_cache(spark, path)


@Q("index_artifacts", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_nationkey = 3) AS e FROM customer)
SELECT 0 AS build, 'rebuild' AS decision, n, n AS encoded, 16 AS dimension FROM n UNION ALL SELECT 1, 'reuse', n, 0, 16 FROM n UNION ALL SELECT 2, 'repair', n, e, 16 FROM n""")
def index_artifacts(spark, d):
    """An index built, built again, and built after the contents of one nation changed."""
    from ..operators.vectors import hash_encoder
    from .artifacts import build_artifact

    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_name", F.when(F.col("c_nationkey") == 3, "new")).alias("content"), F.col("c_name").alias("before"))
    root, out = scratch(spark, "artifacts"), []
    for k, text in enumerate(("before", "before", "content")):
        told = build_artifact(c.select("id", F.col(text).alias("content")), hash_encoder(16), root, "customers", "hash-16")
        out.append((k, told["decision"], told["n"], told["encoded"], told["dimension"]))
    return spark.createDataFrame(out, "build int, decision string, n long, encoded long, dimension int")
