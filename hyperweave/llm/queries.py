"""The subpackage's queries: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontamination, licenses, multiindex, negatives, parity, permutation, pii, quality, repeats, tokenfiles, warc
from .common import read_table

#: Folder of the public vocabulary files; a parameter, since they are not part of the repository.
TOKENIZERS = os.environ.get("HYPERWEAVE_TOKENIZERS", "/opt/tokenizers")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.count_tokens(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op3_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(read_table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return warc.read_archives(spark, written).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_windows(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    return decontamination.report(found, "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 50 == 0)


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(read_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_token_counts": op2_token_counts,
    "op3_warc_archives": op3_warc_archives,
    "op4_repeats": op4_repeats,
    "op5_pii": op5_pii,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_multi_index": op12_multi_index,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_archives": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op7_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM bn)),
firsts AS (SELECT DISTINCT n, g[1] AS f FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM dw),
cand AS (SELECT doc_id, p.k, n, list_slice(w, p.k, p.k + n - 1) AS g FROM pos p JOIN firsts ON w[p.k] = f AND p.k + n - 1 <= len(w)),
occ AS (SELECT doc_id, cand.k, cand.n, item_id FROM cand JOIN win ON cand.n = win.n AND cand.g = win.g),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_repeats": """
WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS p FROM x WHERE length(h) >= 400),
win AS (SELECT doc_id, p, hash(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS g FROM k),
dup AS (SELECT doc_id, p FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
isl AS (SELECT doc_id, p, sum(CASE WHEN p - prev <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS prev FROM dup)),
runs AS (SELECT doc_id, i, min(p) AS a, max(p) + 200 AS b FROM isl GROUP BY 1, 2),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM runs),
per AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM gaps GROUP BY 1),
parts AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * c + 1 AS BIGINT), CAST(2 * (a - c) AS BIGINT)), '' ORDER BY a) AS s FROM gaps g JOIN x USING (doc_id) GROUP BY 1)
SELECT x.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE s || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM x LEFT JOIN per USING (doc_id) LEFT JOIN parts USING (doc_id)""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r(d, m) AS (SELECT x, x FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d),
c AS (SELECT d, min(m) AS m FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.d = w.doc_id""",
}

_VECTORS = """
SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_VEC_SQL = {
    "op11_hard_negatives": f"""
WITH u AS ({_VECTORS}),
r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(v, lambda x: floor(x * 256)) AS v FROM u),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3""",
    "op12_multi_index": f"""
WITH RECURSIVE u AS (SELECT * FROM ({_VECTORS}) WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r(d, m) AS (SELECT x, x FROM l UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.d),
c AS (SELECT d, min(m) AS m FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.d = vec_id""",
}
ORACLE_SQL |= _VEC_SQL

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    """The license scan in SQL: its templates and phrases are those of the operator."""
    rows = ", ".join(f"({k}, '{label}', '{body}')" for k, (label, body) in enumerate(licenses.TEMPLATES))
    places = []
    for phrase, label in licenses.PHRASES:
        words = phrase.split()
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words, 1))
        places.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d WHERE list_contains(w, 'license')) WHERE i + {len(words)} <= len(w) AND {same}")
    lengths = [len(re.findall(r"[^\W_]+", body)) for _, body in licenses.TEMPLATES]
    stretches = ""
    for low, high in licenses.size_classes(lengths):
        span = licenses.SLACK * high
        stretches += f" UNION ALL SELECT doc_id, {low}, {high}, list_distinct(p[k:k + {2 * span - 1}]) FROM (SELECT doc_id, p, unnest(range(1, greatest(len(p) - {span}, 0) + 2, {span})) AS k FROM pg)"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH t AS (SELECT label, len({_WORDS.format('body')}) AS n, list_distinct({_WORDS.format('body')}) AS t FROM (VALUES {rows}) v(k, label, body)),
d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
pg AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{word}') AS p FROM documents),
b AS (SELECT doc_id, 0 AS low, {max(lengths)} AS high, list_distinct({_WORDS.format('line')}) AS w FROM (SELECT doc_id, unnest(lines) AS line FROM d){stretches}),
f AS (SELECT doc_id, label, len(list_intersect(w, t))::DOUBLE / len(t) AS c FROM b, t WHERE n BETWEEN low AND high AND len(list_intersect(w, t)) >= ceil(round({licenses.THRESHOLD} * len(t), 6))),
p AS ({' UNION ALL '.join(places)}),
ps AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z FROM p GROUP BY 1),
pl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT DISTINCT doc_id, label FROM p) GROUP BY 1),
al AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS s FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM f) GROUP BY 1),
fs AS (SELECT doc_id, max(c) AS c FROM f GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(pl.s, '') AS base_labels, coalesce(al.s, '') AS labels, CASE WHEN n IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(c, 0) END AS score
FROM d LEFT JOIN ps USING (doc_id) LEFT JOIN pl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN fs USING (doc_id)"""


ORACLE_SQL["op6_licenses"] = _license_sql()


def _spans_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in `name` (key, k, s, e, m): the base kinds' valid spans of a table's texts, placed by the lengths
    of the matches and of the gaps between them."""
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
    card, phone = r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    found = " UNION ALL ".join(
        f"SELECT {key}, {k} AS k, regexp_extract_all({text}, '{x}') AS ms, regexp_split_to_array({text}, '{x}') AS gs FROM {source} WHERE regexp_matches({text}, '{x}')"
        for k, x in enumerate((email, ip, card, phone))
    )
    return f"""{name}_f AS ({found}),
{name}_p AS (SELECT {key}, k, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {name}_f)),
{name}_d AS (SELECT *, s + length(m) AS e, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS d FROM {name}_p),
{name} AS (SELECT {key}, k, s, e, m FROM {name}_d WHERE CASE k WHEN 0 THEN TRUE
  WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INT), 0) > 255)) = 0
  WHEN 3 THEN length(d) BETWEEN 9 AND 15
  ELSE length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[i] AS INT) ELSE CAST(d[i] AS INT) * 2 - CASE WHEN CAST(d[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 END)"""


def _pii_sql() -> str:
    """The identifiers and the disclosing terms in SQL, with the operator's own thresholds."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    names = "['email', 'ip', 'card', 'phone', 'term']"
    low = lambda x: f"replace(lower({x}), 'ς', 'σ')"
    kept = "concat(k, ':', translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ln AS (SELECT line, count(*) AS copies FROM (SELECT unnest(regexp_extract_all(t, '{pii.STRETCH}')) AS line FROM docs) GROUP BY 1),
{_spans_sql("ls", "ln", "line", "line")},
{_spans_sql("ds", "docs", "doc_id", "t")},
held AS (SELECT DISTINCT line, copies, {kept} AS entity FROM ls JOIN ln USING (line)),
ent AS (SELECT entity, sum(copies) AS n_e FROM held GROUP BY 1 HAVING count(*) >= {pii.SUPPORT}),
cut AS (SELECT line, string_agg(substr(line, c + 1, greatest(s - c, 0)), ' ' ORDER BY s, e) || ' ' || substr(line, max(e) + 1) AS rest FROM (SELECT line, s, e, coalesce(max(e) OVER (PARTITION BY line ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ls) GROUP BY 1),
pr AS (SELECT entity, n_e, term, sum(copies) AS n_te FROM (SELECT entity, n_e, copies, unnest(list_distinct(regexp_extract_all({low("rest")}, '{word}'))) AS term FROM held JOIN ent USING (entity) JOIN cut USING (line)) WHERE length(term) > 1 GROUP BY 1, 2, 3 HAVING count(*) >= {pii.SUPPORT}),
tc AS (SELECT term, sum(copies) AS n_t FROM (SELECT copies, unnest(list_distinct(regexp_extract_all({low("line")}, '{word}'))) AS term FROM ln) WHERE term IN (SELECT term FROM pr) GROUP BY 1),
dt AS (SELECT entity, term FROM pr JOIN tc USING (term) WHERE 1 - log2(greatest(n_t::DOUBLE / n_te, 1)) / log2(((SELECT sum(copies) FROM ln) + 1)::DOUBLE / n_e) >= {pii.THRESHOLD}),
wt AS (SELECT DISTINCT doc_id, term FROM ds JOIN dt ON entity = {kept}),
wd AS (SELECT doc_id, regexp_extract_all(t, '{pii.ANY_WORD}') AS ms, regexp_split_to_array(t, '{pii.ANY_WORD}') AS gs FROM docs WHERE doc_id IN (SELECT doc_id FROM wt)),
ws AS (SELECT doc_id, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM wd)),
ts AS (SELECT ws.doc_id, 4 AS k, s, s + length(m) AS e FROM ws JOIN wt ON wt.doc_id = ws.doc_id AND term = {low("m")} WHERE NOT EXISTS (SELECT 1 FROM ds b WHERE b.doc_id = ws.doc_id AND b.s < ws.s + length(m) AND ws.s < b.e)),
al AS (SELECT doc_id, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM (SELECT doc_id, k, s, e FROM ds UNION ALL SELECT * FROM ts) GROUP BY 1),
ba AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS base FROM ds GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_email, coalesce(n1, 0) AS n_ip, coalesce(n2, 0) AS n_card, coalesce(n3, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN ba USING (doc_id) LEFT JOIN al USING (doc_id)"""


ORACLE_SQL["op5_pii"] = _pii_sql()
