"""Queries of the dataset plane: joins with fallbacks, validation, sampling, balancing and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as L
from ..functions.text import entity_label
from ..operators import dataset as D
from ..operators import joins as J
from ..operators import partition as P
from ..operators.kv import first_per_key
from ..sources.files import prompts_within
from .base import Catalogue, read_table

Q = Catalogue()


def _sides(spark, d):
    """Suppliers and customers that share addresses (a nation's) or else titles (a residue)."""
    build = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("url"), (F.col("s_suppkey") % 5).cast("string").alias("title"), "s_suppkey")
    probe = read_table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 2).alias("url"), (F.col("c_custkey") % 7).cast("string").alias("title"), "c_mktsegment")
    return build, probe


_MATCHES = "b AS (SELECT s_nationkey AS url, CAST(s_suppkey % 5 AS VARCHAR) AS title, s_suppkey FROM supplier), p AS (SELECT c_custkey, c_nationkey * 2 AS url, CAST(c_custkey % 7 AS VARCHAR) AS title, c_mktsegment FROM customer), m AS (SELECT c_custkey, c_mktsegment, s_suppkey AS b_s_suppkey, 'url' AS match_key FROM p JOIN b USING (url) UNION ALL SELECT c_custkey, c_mktsegment, s_suppkey, 'title' FROM p JOIN b USING (title) WHERE c_custkey NOT IN (SELECT c_custkey FROM p JOIN b USING (url)))"


@Q("fallback_key_join", f"WITH {_MATCHES} SELECT c_custkey, c_mktsegment, b_s_suppkey, match_key FROM m")
def fallback(spark, d):
    return J.fallback_join(*_sides(spark, d), "url", "title", "c_custkey", spread=16).select("c_custkey", "c_mktsegment", "b_s_suppkey", "match_key")


@Q("alignment_summary", f"WITH {_MATCHES} SELECT 'match_key' AS dimension, match_key AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(DISTINCT c_custkey) FROM m GROUP BY 2")
def alignment(spark, d):
    return D.alignment_summary(J.fallback_counts(*_sides(spark, d), "url", "title", "c_custkey"), "c_custkey", ["c_mktsegment"], "n")


_REASONS = "r AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 THEN 'duplicate' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN n_chars < 200 THEN 'short' ELSE 'eligible' END AS reason FROM documents)"


@Q("eligibility_reasons", f"WITH {_REASONS} SELECT doc_id, reason FROM r")
def eligibility(spark, d):
    docs = read_table(spark, d, "documents")
    return D.eligibility(docs, "text", "doc_id", [(~F.col("lang").isin("en", "fr"), "language"), (F.col("n_chars") < 200, "short")]).select("doc_id", "reason")


@Q("eligibility_counts", f"WITH {_REASONS} SELECT reason, count(*) AS n FROM r GROUP BY 1")
def eligibility_counts(spark, d):
    return D.counts(eligibility(spark, d), "reason")


@Q("quality_counters", "SELECT lang, count(*) AS rows, count(*) FILTER (text IS NULL OR trim(text) = '') AS missing_text, count(*) FILTER (source IS NULL OR trim(source) = '' OR source = 'src3') AS missing_source FROM documents GROUP BY 1")
def counters(spark, d):
    docs = read_table(spark, d, "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    return D.quality_counters(docs, ["text", "source"], ["lang"])


@Q("candidate_summary", "SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_texts FROM documents GROUP BY 1")
def candidates(spark, d):
    return read_table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("distinct_texts"))


@Q("completeness", "WITH h AS (SELECT lang, count(*) AS complete FROM documents WHERE n_chars > 1000 GROUP BY 1), q AS (SELECT lang, count(*) // 2 AS requested FROM documents GROUP BY 1) SELECT lang, requested, coalesce(complete, 0) AS complete FROM q LEFT JOIN h USING (lang) WHERE coalesce(complete, 0) < requested")
def completeness(spark, d):
    docs = read_table(spark, d, "documents")
    asked = docs.groupBy("lang").agg(F.floor(F.count("*") / 2).alias("requested"))
    return D.completeness(docs.where("n_chars > 1000"), asked, "lang")


@Q("record_validation", "SELECT doc_id, list_filter([CASE WHEN trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE lang END) = '' THEN 'image_id is blank' END, CASE WHEN doc_id % 5 = 0 THEN 'prompt holds <image>' END, CASE WHEN doc_id % 7 = 0 THEN 'schema version' END], lambda x: x IS NOT NULL) AS violations FROM documents")
def validation(spark, d):
    docs = read_table(spark, d, "documents")
    content = F.when(F.col("doc_id") % 5 == 0, "see <image>").otherwise("see")
    rows = docs.select(
        "doc_id", F.lit("a").alias("data_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")).alias("image_id"), F.lit("p").alias("image_path"), F.lit("s").alias("data_source"), F.lit("q").alias("ability"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.struct(F.when(F.col("doc_id") % 7 == 0, "1").otherwise("2").alias("mm_schema_version"), F.array(F.lit("g")).alias("golden_answers")).alias("extra_info"),
    )
    return D.validate_records(rows).select("doc_id", "violations")


@Q("record_build", "SELECT 'kb:' || lang || ':' || doc_id || ':' || source AS data_id, ['a', 'b'] AS ground_truth, text AS content, FALSE AS image_missing FROM documents")
def build(spark, d):
    rows = read_table(spark, d, "documents").select(F.lit("kb").alias("dataset"), F.col("lang").alias("split"), F.col("doc_id").alias("index"), F.col("text").alias("question"), F.array(F.lit(" a"), F.lit("b"), F.lit("a"), F.lit("")).alias("golden_answers"), F.col("source").alias("image_id"), F.lit("x.png").alias("image_path"), F.array(F.lit("c")).alias("context"))
    return D.mm_record(rows).select("data_id", F.col("reward_model.ground_truth").alias("ground_truth"), F.col("prompt")[0]["content"].alias("content"), F.col("extra_info.image_missing").alias("image_missing"))


@Q("contents_assembly", r"SELECT doc_id, array_to_string(list_filter([trim(source), CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END, trim(regexp_replace(text, '\s+', ' ', 'g'))], lambda x: x <> ''), chr(10) || chr(10)) AS contents FROM documents")
def assembly(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("lang")).alias("section"), F.col("text").alias("evidence"))
    return docs.select("doc_id", F.regexp_replace(D.contents("source", "section", "evidence"), r"[ ]+$", "").alias("contents"))


@Q("entity_label", "SELECT doc_id, upper(CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END) AS label FROM documents")
def label(spark, d):
    docs = read_table(spark, d, "documents")
    title = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return docs.select("doc_id", entity_label(title, F.lit("https://x.example"), "source").alias("label"))


@Q("unambiguous_join", "SELECT l_partkey, any_value(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def unambiguous(spark, d):
    return J.unambiguous(read_table(spark, d, "lineitem"), ["l_partkey"], ["l_returnflag"])


@Q("left_prefer_join", "SELECT c_custkey AS k, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, o_orderstatus) AS v, o_totalprice FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def left_prefer(spark, d):
    left = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("v"))
    right = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_totalprice")
    return J.left_prefer(left, right, "k")


@Q("path_resolution", "WITH f AS (SELECT 'img/' || s_suppkey || '.png' AS path FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'alt/' || s_suppkey || '.jpg' FROM supplier WHERE s_suppkey % 3 = 0) SELECT c_custkey, coalesce((SELECT path FROM f WHERE path = 'img/' || c_custkey || '.png'), (SELECT path FROM f WHERE path = 'alt/' || c_custkey || '.jpg')) AS path FROM customer")
def paths(spark, d):
    s = read_table(spark, d, "supplier")
    name = lambda a, k, b: F.concat(F.lit(a), F.col(k).cast("string"), F.lit(b))
    listing = s.where("s_suppkey % 2 = 0").select(name("img/", "s_suppkey", ".png").alias("path")).union(s.where("s_suppkey % 3 = 0").select(name("alt/", "s_suppkey", ".jpg")))
    return J.resolve_paths(read_table(spark, d, "customer"), F.array(name("img/", "c_custkey", ".png"), name("alt/", "c_custkey", ".jpg")), listing, "c_custkey")


@Q("selected_mapping", "WITH m AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey % 2) AS n, CAST(min(s_suppkey % 2) AS VARCHAR) AS path FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1) SELECT n_nationkey AS k, n_nationkey AS pos, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'ok' END AS status, CASE WHEN n = 1 THEN path END AS path FROM nation LEFT JOIN m ON k = n_nationkey")
def mapping(spark, d):
    m = read_table(spark, d, "supplier").where("s_nationkey % 3 > 0").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 2).cast("string").alias("path"))
    return J.selected_mapping(m, read_table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("pos")), "k", "path", "pos")


@Q("metadata_precedence", "SELECT n_nationkey AS name, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'a' END, CASE WHEN n_nationkey % 3 = 0 THEN 'b' END, 'c') AS sha256 FROM nation")
def precedence(spark, d):
    n = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("name"))
    return J.expected_metadata(n.withColumn("sha256", F.lit("c")), n.where("name % 2 = 0").withColumn("sha256", F.lit("a")), n.where("name % 3 = 0").withColumn("sha256", F.lit("b")), "name", ["sha256"])


@Q("url_fan_out", "SELECT c_custkey, 'u' || (c_nationkey + k) AS url, 't' || k AS title FROM customer, (SELECT unnest([0, 1]) AS k)")
def fan_out(spark, d):
    hits = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    name = lambda k: F.concat(F.lit("u"), (F.col("n_nationkey") + k).cast("string"))
    side = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.array(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")), name(1)).alias("urls"), F.array(F.lit("t0"), F.lit("t1")).alias("titles"))
    return J.fan_out(hits, side, "c_nationkey").drop("c_nationkey")


@Q("zip_union", "SELECT c_custkey, c_nationkey, c_name, c_acctbal FROM customer")
def zip_union(spark, d):
    c = read_table(spark, d, "customer")
    return J.zip_union(c.select("c_custkey", "c_nationkey", "c_name"), c.select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")


@Q("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return P.sample(read_table(spark, d, "documents").select("doc_id", "lang"), 100, "doc_id")


@Q("stratified_round_robin", "WITH a AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS t FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY t, source) AS k FROM a) SELECT doc_id, lang, source, row_number() OVER (ORDER BY k, lang) AS place FROM b")
def round_robin(spark, d):
    return P.round_robin(read_table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id")


@Q("bounded_samples", "SELECT doc_id, lang, CAST(place AS INT) AS place, total FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY lang) AS total FROM documents) WHERE place <= 10")
def bounded(spark, d):
    return P.bounded_samples(read_table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 10)


@Q("size_guard", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 5000 ORDER BY doc_id LIMIT 50")
def size_guard(spark, d):
    return P.size_guard(read_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 5000, 50, "doc_id")


@Q("running_budget", "SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 500000")
def budget(spark, d):
    return P.running_budget(read_table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 500000)


@Q("repeat_rows", "SELECT n_nationkey AS pos, CAST(copy AS INT) AS copy, row_number() OVER (ORDER BY n_nationkey, copy) - 1 AS place FROM nation, (SELECT unnest(range(3)) AS copy)")
def repeat_rows(spark, d):
    return P.repeated(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("pos")), 3)


@Q("pad_to_divisor", "SELECT n_nationkey, FALSE AS is_pad FROM nation UNION ALL SELECT n_nationkey, TRUE FROM (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 7)")
def pad(spark, d):
    return P.padded_to(read_table(spark, d, "nation").select("n_nationkey"), 8, "n_nationkey")


@Q("mini_batches", "SELECT n_nationkey, CAST((row_number() OVER (ORDER BY md5('43:' || n_nationkey), n_nationkey) - 1) // 4 AS BIGINT) AS batch FROM nation")
def batches(spark, d):
    return P.mini_batches(read_table(spark, d, "nation").select("n_nationkey"), 4, 1, "n_nationkey")


def _lengths(spark, d):
    return read_table(spark, d, "benchmark").select("item_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))


@Q("balanced_bins")
def balanced(spark, d):
    return P.balanced_bins(_lengths(spark, d), "item_id", "n", 4)


@Q("micro_batches", "SELECT count(*) AS n_rows, sum(n) AS total, CAST(ceil(sum(n) / 200000.0) AS BIGINT) AS n_bins, TRUE AS even FROM (SELECT length(text) AS n FROM documents)")
def micro(spark, d):
    """Whole documents in as many bins as 200,000 characters each ask for: all are placed, and no two bins differ by more
    than the longest document."""
    docs = read_table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    bins = P.micro_batched(docs, "doc_id", "n", 200_000).groupBy("bin").agg(F.count("*").alias("rows"), F.sum("n").alias("s"), F.max("n").alias("longest"))
    return bins.agg(F.sum("rows").alias("n_rows"), F.sum("s").alias("total"), F.count("*").alias("n_bins"), (F.max("s") - F.min("s") <= F.max("longest")).alias("even"))


@Q("greedy_bins", """WITH RECURSIVE x AS (SELECT item_id, length(text) AS n, row_number() OVER (ORDER BY item_id) AS r FROM benchmark), f(r, s, b) AS (SELECT 0::BIGINT, [0, 0, 0, 0]::BIGINT[], 0::BIGINT UNION ALL SELECT x.r, list_transform(s, lambda v, i: CASE WHEN i = list_position(s, list_min(s)) THEN v + n ELSE v END), list_position(s, list_min(s)) - 1 FROM f JOIN x ON x.r = f.r + 1) SELECT item_id, CAST(b AS INT) AS bin, CAST(n AS INT) AS n FROM f JOIN x USING (r)""")
def greedy(spark, d):
    return P.greedy_bins(_lengths(spark, d), "item_id", "n", 4)


@Q("imbalance", "SELECT min(s) AS least, max(s) AS most, round(avg(s), 6) AS mean FROM (SELECT sum(n_chars) AS s FROM documents GROUP BY source)")
def imbalance(spark, d):
    return P.imbalance(read_table(spark, d, "documents"), "source", "n_chars").withColumn("mean", F.round("mean", 6))


@Q("json_profile", "WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) SELECT 'object' AS kind, (SELECT count(*) FROM events) AS n, list_sort(list_distinct(list(key))) AS keys FROM k")
def json_profile(spark, d):
    return D.json_profile(read_table(spark, d, "events"), "props")


@Q("payload_pairs", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def pairs(spark, d):
    return D.payload_pairs(read_table(spark, d, "events"), "props").groupBy("key").agg(F.count("*").alias("n"))


@Q("readiness", "SELECT lang, bool_and(ok) AS ready, coalesce(list_sort(list(name) FILTER (NOT ok)), []) AS blockers FROM (SELECT lang, source AS name, min(n_chars) > 40 AS ok FROM documents GROUP BY 1, 2) GROUP BY 1")
def readiness(spark, d):
    checks = read_table(spark, d, "documents").groupBy("lang", F.col("source").alias("name")).agg((F.min("n_chars") > 40).alias("ok"))
    return D.readiness(checks, "lang")


@Q("asset_report", "SELECT page_id AS name, CASE WHEN page_id % 4 = 0 THEN 'missing' WHEN page_id % 4 = 1 THEN 'wrong size' WHEN page_id % 4 = 2 THEN 'wrong checksum' ELSE 'ok' END AS status FROM pages")
def assets(spark, d):
    p = read_table(spark, d, "pages")
    listed = p.select(F.col("page_id").alias("name"), F.when(F.col("page_id") % 4 == 2, "0").otherwise(F.sha2("html", 256)).alias("sha256"), (F.octet_length("html") + F.when(F.col("page_id") % 4 == 1, 1).otherwise(0)).alias("size"))
    files = p.where("page_id % 4 <> 0").select(F.col("page_id").alias("name"), F.col("html").cast("binary").alias("content"))
    return D.asset_report(listed, files).select("name", "status")


@Q("first_file_wins", "SELECT l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber AS o FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_file(spark, d):
    """Of rows with the same order, the one that the table holds first; rows without an order come last, as in the SQL."""
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    rows = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), *place)
    return first_per_key(rows, ["l_partkey"], [F.asc_nulls_last("o"), F.col("file"), F.col("place")]).drop("file", "place")


@Q("image_compaction", "WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS place FROM f) SELECT user_id, CAST(place AS INT) AS place, event_type FROM r WHERE place <= 3")
def compaction(spark, d):
    return L.compact_images(read_table(spark, d, "events"), "user_id", "event_type", "event_id", ["event_type"])


@Q("edit_scope", "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'lang is not loaded' WHEN source <> 'src0' THEN 'source is not loaded' END AS error FROM documents")
def scope(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", L.scope_error(docs, {"lang": "en", "source": "src0"}).alias("error"))


@Q("coerced_results", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS knowledge, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 0.25 END AS coherence FROM events")
def coerced(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, '["a"]').otherwise('[{"knowledge":"b","coherence":0.25}]')
    return read_table(spark, d, "events").select("event_id", F.explode(L.coerced_results(text)).alias("x")).select("event_id", "x.*")


@Q("manifest_validation", "SELECT event_id, list_filter([CASE WHEN event_id % 2 = 0 THEN 'version' END, CASE WHEN event_id % 3 = 0 THEN 'status' END, CASE WHEN event_id % 5 < 4 THEN 'subset incomplete' END], lambda x: x IS NOT NULL) AS blockers FROM events")
def manifest(spark, d):
    text = F.to_json(F.struct((F.lit(1) + (F.col("event_id") % 2 == 0).cast("int")).alias("version"), F.lit("d").alias("dataset"), F.when(F.col("event_id") % 3 == 0, "partial").otherwise("complete").alias("status"), F.lit(4).alias("requested"), (F.col("event_id") % 5).alias("complete"), F.lit(9).alias("images")))
    return read_table(spark, d, "events").select("event_id", L.manifest_violations(text, "d").alias("blockers"))


@Q("exploded_contents", "SELECT event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['a', 'b'] ELSE ['one'] END) AS content FROM events")
def exploded(spark, d):
    raw = F.when(F.col("event_id") % 2 == 0, '["a", " ", "b"]').otherwise("one")
    return L.exploded_contents(read_table(spark, d, "events").select("event_id", raw.alias("raw")), "raw").select("event_id", "content")


@Q("archive_profile", "SELECT '.' || lang AS suffix, count(*) AS n, sum(n_chars) AS bytes, list_slice(list_sort(list(doc_id || '.' || lang)), 1, 5) AS samples FROM documents GROUP BY 1")
def archives(spark, d):
    docs = read_table(spark, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("."), F.col("lang")).alias("member"), F.col("n_chars").alias("size"))
    return L.archive_profile(docs)


@Q("golden_answers", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE [source] END AS golds FROM documents")
def golds(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("golden_answers")).alias("extra_info"), F.struct(F.array("source").alias("ground_truth")).alias("reward_model"))
    return docs.select("doc_id", L.golden_answers(docs).alias("golds"))


@Q("prompt_template", "SELECT doc_id, 'Q: ' || lang || ' in ' || source || '?' AS prompt FROM documents")
def templates(spark, d):
    return read_table(spark, d, "documents").select("doc_id", L.prompt("Q: {lang} in {source}?", lang=F.col("lang"), source=F.col("source")).alias("prompt"))


@Q("prompt_length_filter", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 200")
def prompt_lengths(spark, d):
    return prompts_within(read_table(spark, d, "documents").select("doc_id", "text"), F.col("text"), 200).select("doc_id")
