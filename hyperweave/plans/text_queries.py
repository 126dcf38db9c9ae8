"""Queries of the text plane: documents, chunks, records and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins, merges
from ..operators.kv import first_per_key
from . import construction as C
from .base import Catalogue, read_table

Q = Catalogue()


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@Q("doc_ids", "SELECT DISTINCT 'doc-' || md5(trim(text)) AS id FROM documents")
def doc_ids(spark, d):
    return _docs(spark, d).select(X.document_id("text").alias("id")).distinct()


@Q("chunking", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 704)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(s // 704 AS INT) AS chunk_order_index, CAST(least(768, len(w) - s) AS INT) AS tokens, array_to_string(list_slice(w, s + 1, s + 768), ' ') AS content FROM s""")
def chunking(spark, d):
    return X.token_chunks(_docs(spark, d), "doc_id", "text")


@Q("contents_dedup", "SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY trim(text)")
def contents_dedup(spark, d):
    return merges.distinct_contents(_docs(spark, d), "text", "doc_id").select("doc_id")


@Q("section_group", r"""WITH t AS (SELECT lang || (doc_id // 20) AS title, source AS section, text AS t, min(doc_id) AS p FROM documents GROUP BY 1, 2, 3)
SELECT title, section, string_agg(t, chr(10) || chr(10) ORDER BY p) AS contents, left(sha1(title || chr(10) || section), 16) AS id FROM t GROUP BY 1, 2""")
def section_group(spark, d):
    """Titles of some twenty documents, parted by source."""
    return merges.group_sections(_docs(spark, d), F.concat("lang", F.expr("doc_id div 20").cast("string")), F.col("source"), "text", "doc_id")


@Q("fingerprint", """WITH h AS (SELECT sha256(length(text) || ':' || text) AS h FROM documents),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)) AS c, sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)) AS d FROM h)
SELECT n, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS fingerprint FROM s""")
def fingerprint(spark, d):
    return merges.fingerprint(_docs(spark, d), "text")


@Q("text_packing", r"""WITH RECURSIVE x AS (SELECT lang, doc_id, text AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
p(lang, r, size, pack) AS (SELECT lang, r, length(t), 0 FROM x WHERE r = 1 UNION ALL SELECT x.lang, x.r, CASE WHEN p.size + 2 + length(t) > 2000 THEN length(t) ELSE p.size + 2 + length(t) END, CASE WHEN p.size + 2 + length(t) > 2000 THEN pack + 1 ELSE pack END FROM p JOIN x ON x.lang = p.lang AND x.r = p.r + 1)
SELECT p.lang, CAST(pack AS INT) AS pack, string_agg(t, chr(10) || chr(10) ORDER BY p.r) AS text FROM p JOIN x USING (lang, r) GROUP BY 1, 2""")
def packing(spark, d):
    return merges.pack(_docs(spark, d).select("lang", "doc_id", "text"), "lang", "doc_id", "text", 2000)


@Q("text_normalisers", r"""SELECT doc_id, regexp_replace(trim(text), '[\x00-\x1f\x7f-\x{9f}]', '', 'g') AS clean, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS query_key,
trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '([\p{L}\p{N}\p{M}]+)', chr(1) || '\1' || chr(2), 'g'), '\x01(a|an|the)\x02', ' ', 'g'), chr(1) || chr(2), ''), '\s+', ' ', 'g')) AS answer_key,
CASE WHEN length(c) > 60 THEN rtrim(left(c, 57)) || '...' ELSE c END AS summary,
CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS preview,
trim(regexp_replace(source, '[^A-Za-z0-9_.-]', '_', 'g'), '._-') AS dataset
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents)""")
def normalisers(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", X.clean("text", entities=False).alias("clean"), X.query_key("text").alias("query_key"), X.answer_key("text").alias("answer_key"), X.summary("text", 60).alias("summary"), X.preview("text").alias("preview"), X.dataset_name("source").alias("dataset"))


@Q("clean_entities", "SELECT page_id, '<b> & é ' || url AS clean FROM pages")
def clean_entities(spark, d):
    p = read_table(spark, d, "pages")
    return p.select("page_id", X.clean(F.concat(F.lit(" &lt;b&gt; &amp; &eacute; "), "url")).alias("clean"))


@Q("text_parsers", r"""SELECT doc_id, ['a', 'b', 'c'] AS answers, ['1', '2', '3'] AS images, CASE doc_id % 4 WHEN 0 THEN 'inaturalist' WHEN 1 THEN 'gldv2' WHEN 2 THEN 'oven' ELSE 'unknown' END AS source_kind,
'datasets_mm/x/' || doc_id AS path, CAST(doc_id % 2 AS BOOLEAN) AS safe, doc_id % 3 = 0 AS number FROM documents""")
def parsers(spark, d):
    t = _docs(spark, d).select("doc_id")
    kinds = F.element_at(F.array(F.lit("123"), F.lit("0123456789abcdef"), F.lit("oven_7"), F.lit("x y")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("C:\\data\\datasets_mm\\x\\"), F.col("doc_id").cast("string"))
    name = F.when(F.col("doc_id") % 2 == 1, "a/b.png").otherwise("../b.png")
    num = F.element_at(F.array(F.lit("-1.5"), F.lit("1e5"), F.lit("x")), (F.col("doc_id") % 3 + 1).cast("int"))
    return t.select("doc_id", X.answer_parts(F.lit("a| b&&c |a")).alias("answers"), X.image_ids(F.lit("1,2; 3")).alias("images"), X.image_source(kinds).alias("source_kind"), X.portable_path(path).alias("path"), X.safe_path(name).alias("safe"), X.is_number(num).alias("number"))


@Q("marker_split", "SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents")
def marker_split(spark, d):
    return _docs(spark, d).select("doc_id", X.split_on("text", [". "]).alias("parts"))


@Q("record_parse", r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '. '), lambda x: trim(translate(x, '()#', ''))), lambda x: x <> '')) AS h, unnest(range(len(list_filter(list_transform(string_split(text, '. '), lambda x: trim(translate(x, '()#', ''))), lambda x: x <> '')))) AS k FROM documents)
SELECT doc_id, '<hyperedge>' || regexp_replace(trim(h), '[\x00-\x1f\x7f]', '', 'g') AS name, CAST(k % 5 AS DOUBLE) AS weight FROM s WHERE NOT contains(h, chr(10))""")
def record_parse(spark, d):
    parts = F.filter(F.transform(F.split("text", r"\. "), lambda x: F.trim(F.translate(x, "()#", ""))), lambda x: x != "")
    lines = F.transform(parts, lambda x, i: F.concat(F.lit('("hyper-relation"<|>'), x, F.lit("<|>"), (i % 5).cast("string"), F.lit(")")))
    r = _docs(spark, d).select(F.col("doc_id").alias("chunk"), F.array_join(lines, "##").alias("response"))
    return C.parse_records(r).select(F.col("chunk").alias("doc_id"), "name", "weight")


@Q("graph_build", r"""WITH f AS (SELECT DISTINCT trim(text) AS t FROM documents WHERE trim(text) <> '') SELECT 'doc-' || md5(t) AS id, t AS content FROM f""")
def graph_build(spark, d):
    return C.insert_documents(_docs(spark, d), "text")["full_docs"]


@Q("graph_build_entities")
def graph_build_entities(spark, d):
    return C.insert_documents(_docs(spark, d), "text")["entities"].drop("sources")


@Q("graph_build_incidence")
def graph_build_incidence(spark, d):
    return C.insert_documents(_docs(spark, d), "text")["incidence"].drop("sources")


@Q("custom_graph_insert", "WITH n AS (SELECT upper(s_name) AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' ELSE 'UNKNOWN' END AS type, s_name AS description, CASE WHEN s_nationkey < 20 THEN 'chunk-' || md5('nation ' || s_nationkey) ELSE 'UNKNOWN' END AS source FROM supplier) SELECT * FROM n UNION ALL SELECT DISTINCT upper(n_name), 'UNKNOWN', 'UNKNOWN', 'UNKNOWN' FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def custom(spark, d):
    s, n = read_table(spark, d, "supplier"), read_table(spark, d, "nation")
    sid = F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_id")
    chunks = n.where("n_nationkey < 20").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.concat(F.lit(" nation "), F.col("n_nationkey").cast("string")).alias("content"))
    ents = s.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "supplier").alias("type"), F.col("s_name").alias("description"), sid)
    rels = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("in").alias("description"), F.lit(None).cast("double").alias("weight"), sid)
    return C.insert_custom(chunks, ents, rels)["nodes"]


@Q("jaccard_fuzzy", r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '')) AS w FROM benchmark),
a AS (SELECT item_id AS ask, CASE WHEN len(w) > 5 AND item_id % 2 = 0 THEN list_slice(w, 1, len(w) - 2) ELSE w END AS w FROM t),
p AS (SELECT ask, item_id AS id, len(list_intersect(a.w, t.w)) AS b, len(a.w) + len(t.w) AS s FROM a, t),
r AS (SELECT ask, id, CAST(b AS DOUBLE) / (s - b) AS jaccard, row_number() OVER (PARTITION BY ask ORDER BY CAST(b AS DOUBLE) / (s - b) DESC, id) AS r FROM p WHERE b > 0 AND CAST(b AS DOUBLE) / (s - b) >= 0.8)
SELECT ask, id, jaccard FROM r WHERE r = 1""")
def jaccard(spark, d):
    b = read_table(spark, d, "benchmark")
    w = F.array_distinct(F.filter(F.split(X.query_key("text"), " "), lambda x: x != ""))
    cut = F.when((F.size("w") > 5) & (F.col("ask") % 2 == 0), F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0)))).otherwise(F.col("w"))
    asked = b.select(F.col("item_id").alias("ask"), w.alias("w")).select("ask", F.array_join(cut, " ").alias("text"))
    return joins.jaccard_best(asked, b.select(F.col("item_id").alias("id"), F.col("item_id").alias("pos"), F.col("text").alias("content")))


@Q("substring_resolve", r"""WITH s AS (SELECT item_id AS id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS c FROM benchmark), a AS (SELECT id AS ask, CASE id % 3 WHEN 0 THEN c WHEN 1 THEN trim(left(c, CAST(floor(length(c) * 0.7) AS INT))) ELSE trim(left(c, CAST(floor(length(c) * 0.3) AS INT))) END AS t FROM s),
e AS (SELECT ask, min(id) AS id, 'exact' AS how FROM a JOIN s ON t = c GROUP BY ask),
n AS (SELECT ask, s.id, row_number() OVER (PARTITION BY ask ORDER BY length(t)::DOUBLE / length(c) DESC, s.id) AS r FROM a JOIN s ON contains(c, t) AND length(t)::DOUBLE / length(c) >= 0.5 WHERE length(t) >= 10 AND ask NOT IN (SELECT ask FROM e))
SELECT * FROM e UNION ALL SELECT ask, id, 'contains' FROM n WHERE r = 1""")
def substring(spark, d):
    b = read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    c = X.query_key("content")
    part = lambda p: F.trim(F.substring(c, F.lit(1), F.floor(F.length(c) * p).cast("int")))
    asked = b.select(F.col("id").alias("ask"), F.when(F.col("id") % 3 == 0, c).when(F.col("id") % 3 == 1, part(0.7)).otherwise(part(0.3)).alias("text"))
    return joins.substring_resolve(asked, b.withColumn("pos", F.col("id")))


@Q("answer_in_section", r"""WITH p AS (SELECT doc_id AS page, list_transform(string_split(text, chr(10)), lambda x: ' ' || trim(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ') AS s FROM documents), x AS (SELECT page, unnest(s) AS t, unnest(range(len(s))) AS section FROM p), h AS (SELECT page, section, 'of the' AS alias, 0 AS k FROM x WHERE contains(t, ' of the ') UNION ALL SELECT page, section, 'and', 1 FROM x WHERE contains(t, ' and ')),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY section, k) AS r FROM h) SELECT page, CAST(section AS INT) AS section, alias FROM r WHERE r = 1""")
def answer_section(spark, d):
    t = _docs(spark, d)
    pages = t.select(F.col("doc_id").alias("page"), F.split("text", "\n").alias("sections"))
    answers = t.select(F.col("doc_id").alias("page"), F.array(F.lit("of  The"), F.lit("and")).alias("aliases"))
    return joins.answer_section(pages, answers).withColumn("alias", X.compact("alias"))


@Q("carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question FROM conversations")
def carry(spark, d):
    c = read_table(spark, d, "conversations")
    return c.select("conv_id", "turn", merges.carry_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text"))).alias("question"))


@Q("unique_suffix", "SELECT doc_id, CASE WHEN r = 0 THEN source ELSE source || '_' || r END AS unique_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents)")
def unique_suffix(spark, d):
    return merges.unique_suffix(_docs(spark, d).select("doc_id", "source"), "source", "doc_id").select("doc_id", "unique_id")


@Q("content_lookup", r"SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content, min(doc_id) AS doc_id FROM documents WHERE lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) <> '' GROUP BY 1")
def lookup(spark, d):
    return merges.content_lookup(_docs(spark, d), X.query_key("text"), "doc_id", "doc_id")


@Q("first_valid_turn", "SELECT conv_id, min(turn) AS turn FROM conversations WHERE trim(text) <> '' AND role = 'assistant' GROUP BY 1")
def first_turn(spark, d):
    c = read_table(spark, d, "conversations").where((F.trim("text") != "") & (F.col("role") == "assistant"))
    return first_per_key(c, ["conv_id"], [F.col("turn")]).select("conv_id", "turn")
