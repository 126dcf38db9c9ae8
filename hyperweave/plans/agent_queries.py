"""Queries of the agent's plane, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mathematics as M
from ..functions import records as R
from ..operators import trajectories as A
from .base import Catalogue, read_table

Q = Catalogue()


@Q("json_safe", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS value, CAST(coalesce((event_id % 3 = 2 AND value IS NOT NULL)::INT, 0) + (value IS NOT NULL)::INT AS INT) AS kept FROM events")
def json_safe(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("value").cast("double"))
    e = read_table(spark, d, "events").select("event_id", F.struct(odd.alias("v"), F.array(odd, F.col("value").cast("double")).alias("l")).alias("x"))
    safe = e.withColumn("x", R.json_safe("x", e.schema["x"].dataType))
    return safe.select("event_id", F.col("x.v").alias("value"), F.size(F.filter("x.l", lambda y: y.isNotNull())).alias("kept"))


@Q("page_addresses", "SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN 'u' || doc_id END AS url, CASE WHEN doc_id % 6 < 5 AND doc_id % 6 <> 1 THEN 't' || doc_id END AS title FROM documents")
def page_addresses(spark, d):
    i = F.col("doc_id").cast("string")
    url, title = F.concat(F.lit("u"), i), F.concat(F.lit("t"), i)
    both = F.struct(url.alias("wikipedia_url"), title.alias("wikipedia_title"))
    blank = F.struct(F.lit(" ").alias("wikipedia_url"))
    forms = [both, F.struct(F.struct(url.alias("evidence_page_url")).alias("source_row")), F.struct(both.alias("source_row"), F.lit("").alias("wikipedia_url")), F.struct(F.struct(both.alias("source_row")).alias("original_metadata")), F.struct(F.array(both).alias("source_rows")), blank]
    meta = F.coalesce(*(F.when(F.col("doc_id") % 6 == k, F.to_json(x)) for k, x in enumerate(forms)))
    return read_table(spark, d, "documents").select("doc_id", R.page_url(meta).alias("url"), R.page_title(meta).alias("title"))


def _rows(spark, d):
    turns = read_table(spark, d, "conversations").select("conv_id", F.struct("turn", (F.length("text") % 7).cast("double").alias("score"), (F.length("text") % 5).cast("double").alias("value"), (F.col("role") == "assistant").cast("int").alias("mask")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.score").alias("score"), F.col("t.value").alias("value"), F.col("t.mask").alias("mask"), F.transform("t.mask", lambda m: 1 - m).alias("prompt"))


_TURNS = "t AS (SELECT conv_id, turn, CAST(length(text) % 7 AS DOUBLE) AS score, CAST(length(text) % 5 AS DOUBLE) AS value, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask FROM conversations), r AS (SELECT conv_id, sum(score) AS score, sum(mask) AS n, count(*) - sum(mask) AS p, count(*) AS places FROM t GROUP BY conv_id)"


@Q("token_metrics", f"WITH {_TURNS}, a AS (SELECT round(avg(score), 6) AS score_row_mean, max(score) AS score_row_max, CAST(max(n) AS DOUBLE) AS response_length_max, CAST(min(p) AS DOUBLE) AS prompt_length_min, round(avg(CASE WHEN n = (SELECT max(places) FROM r) THEN 1.0 ELSE 0.0 END), 6) AS response_length_clip_ratio FROM r), b AS (SELECT round(avg(score), 6) AS score_mean, max(value) AS value_max, round(1 - var_samp(score - value) / (var_samp(score) + 1e-5), 6) AS explained_variance FROM t WHERE mask = 1) SELECT * FROM a, b")
def token_metrics(spark, d):
    m = A.token_metrics(_rows(spark, d), ["score", "value"], "prompt", "mask", ("score", "value"))
    return m.select("score_row_max", "response_length_max", "prompt_length_min", "value_max", *(F.round(x, 6).alias(x) for x in ("score_row_mean", "response_length_clip_ratio", "score_mean", "explained_variance")))


@Q("reward_at_last_token", f"WITH {_TURNS} SELECT conv_id, CAST(CASE WHEN n > 0 THEN n - 1 ELSE places - 1 END AS INT) AS place, 2.5::DOUBLE AS reward, CAST(places AS INT) AS places FROM r")
def reward_at_last_token(spark, d):
    placed = _rows(spark, d).select("conv_id", R.reward_at_last(F.lit(2.5), "mask").alias("r"))
    return placed.select("conv_id", (F.array_position("r", 2.5) - 1).cast("int").alias("place"), F.aggregate("r", F.lit(0.0), lambda s, x: s + x).alias("reward"), F.size("r").alias("places"))


@Q("reward_pairs", "WITH i AS (SELECT p_partkey, list_concat(range(1, p_partkey % 4 + 2), [7]) AS good, list_concat(range(1, p_partkey % 4 + 2), [8, 8, 8]) AS bad FROM part), e AS (SELECT p_partkey, list_concat(good, [99])[1:6] AS good, list_concat(bad, [99])[1:6] AS bad FROM i) SELECT p_partkey, array_to_string(list_resize(good, 6, 0), ',') AS chosen, array_to_string(list_resize(bad, 6, 0), ',') AS rejected, CAST(len(good) AS INT) AS n_chosen, CAST(len(bad) AS INT) AS n_rejected FROM e")
def reward_pairs(spark, d):
    prompt = F.sequence(F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int"))
    pair = R.reward_pair(prompt, F.array(F.lit(7)), F.array(*[F.lit(8)] * 3), 6, eos=99)
    p = read_table(spark, d, "part").select("p_partkey", pair.alias("x"))
    names = [("chosen", 0), ("rejected", 1)]
    text = [F.array_join(F.col("x.ids")[k].cast("array<string>"), ",").alias(n) for n, k in names]
    return p.select("p_partkey", *text, *(F.aggregate(F.col("x.mask")[k], F.lit(0), lambda s, y: s + y).alias(f"n_{n}") for n, k in names))


@Q("fold_batch", "SELECT n_nationkey, CAST((row_number() OVER (ORDER BY n_name) - 1) // 5 AS BIGINT) AS block, CAST((row_number() OVER (ORDER BY n_name) - 1) % 5 AS BIGINT) AS at FROM nation")
def fold_batch(spark, d):
    return A.fold_batch(read_table(spark, d, "nation").select("n_nationkey", "n_name"), 5, "n_name").select("n_nationkey", "block", "at")


@Q("padded_responses", "WITH t AS (SELECT conv_id, turn, least(CAST(length(text) AS INT), 40) AS n FROM conversations), m AS (SELECT max(n) AS m FROM t) SELECT conv_id, turn, n AS own, CAST(m AS INT) AS size FROM t, m")
def padded_responses(spark, d):
    c = read_table(spark, d, "conversations").select("conv_id", "turn", F.array_repeat(F.lit(1), F.length("text")).alias("ids"))
    p = A.padded_responses(c, "ids", 40, 0)
    return p.select("conv_id", "turn", F.size(F.filter("ids", lambda x: x == 1)).alias("own"), F.size("ids").alias("size"))


@Q("queue_stats", "WITH r AS (SELECT event_type AS status, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) SELECT status, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY r) FILTER (r <= 20) AS last FROM r GROUP BY 1")
def queue_stats(spark, d):
    s = A.queue_stats(read_table(spark, d, "events"), "event_id", "event_type")
    return s.withColumn("last", F.array_join(F.col("last").cast("array<string>"), ","))


@Q("deferred_tasks", "SELECT event_id, event_id % 10 <= 4 AS now FROM events")
def deferred_tasks(spark, d):
    now, later = A.due(read_table(spark, d, "events").select("event_id", (F.col("event_id") % 10).alias("train_step")), 4)
    return now.select("event_id", F.lit(True).alias("now")).unionByName(later.select("event_id", F.lit(False).alias("now")))


@Q("transfer_plan", "WITH p AS (SELECT count(*) AS n, sum(p_size) AS bytes FROM part) SELECT CASE WHEN n > 1000 OR bytes > 20000 OR n >= 100000 THEN 0 ELSE n END AS planned, CAST(bytes AS BIGINT) AS bytes, concat_ws(',', CASE WHEN n >= 100000 THEN 'near_full_mirror' END, CASE WHEN n > 1000 THEN 'max_shards_exceeded' END, CASE WHEN bytes > 20000 THEN 'max_transfer_exceeded' END) AS blockers FROM p")
def transfer_plan(spark, d):
    return A.transfer_plan(read_table(spark, d, "part"), "p_size", 1000, 20000, 100000).withColumn("blockers", F.array_join("blockers", ","))


@Q("copied_stats", "WITH s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'outside' WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'present' END AS state FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY doc_id) AS r FROM s) SELECT state, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (r <= 10) AS first FROM r GROUP BY 1")
def copied_stats(spark, d):
    i = F.col("doc_id")
    docs = read_table(spark, d, "documents").select(i.alias("index"), i.cast("string").alias("image_id"), F.concat(F.when(i % 5 == 0, "set/../").otherwise("set/images/"), i.cast("string")).alias("path"))
    stats = A.copied_stats(docs, docs.where("index % 3 <> 0").select("path"), "set")
    return stats.select("state", "n", F.array_join(F.transform("samples", lambda x: x["image_id"]), ",").alias("first"))


@Q("format_hits", "SELECT e.vec_id AS id, coalesce(d.lang, e.vec_id::VARCHAR) AS knowledge, coalesce(d.doc_id % 4 = 0, false) AS deleted, NOT coalesce(d.doc_id % 4 = 0, false) AS active, coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.doc_id::DOUBLE END, 1.0) AS weight FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id AND d.doc_id % 2 = 0")
def format_hits(spark, d):
    i = F.col("doc_id")
    records = read_table(spark, d, "documents").where(i % 2 == 0).select(i.alias("id"), F.col("lang").alias("content"), (i % 4 == 0).alias("deleted"), F.lit(None).cast("boolean").alias("active"), F.when(i % 3 > 0, i.cast("double")).alias("weight"))
    hits = read_table(spark, d, "embeddings").select(F.lit("q").alias("query"), F.lit("text").alias("modality"), F.col("vec_id").alias("id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return A.format_hits(hits, records).select("id", "knowledge", "deleted", "active", "weight")


@Q("merged_candidates", "WITH f AS (SELECT source || '-' || lang AS value, min(struct_pack(r := doc_id % 3, p := doc_id)) AS o FROM documents GROUP BY 1) SELECT value, row_number() OVER (ORDER BY o, value) AS rank FROM f")
def merged_candidates(spark, d):
    reports = read_table(spark, d, "documents").select((F.col("doc_id") % 3).alias("report"), F.col("doc_id").alias("pos"), F.concat("source", F.lit("-"), "lang").alias("value"))
    return A.merged_candidates(reports)


@Q("selected_ids", "WITH r AS (SELECT event_id AS pos, CASE WHEN event_id % 7 = 0 THEN 'bad id' ELSE 'img' || user_id END AS image_id FROM events WHERE event_type = 'click') SELECT min(pos) AS pos, image_id, 'selected' AS state FROM r WHERE image_id <> 'bad id' GROUP BY 2 UNION ALL SELECT pos, image_id, 'invalid_image_id' FROM r WHERE image_id = 'bad id'")
def selected_ids(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("event_type").alias("source"), F.when(F.col("event_id") % 7 == 0, "bad id").otherwise(F.concat(F.lit("img"), F.col("user_id").cast("string"))).alias("image_id"))
    good, bad = A.selected_ids(e, "click", r"^\w+$")
    return good.withColumn("state", F.lit("selected")).unionByName(bad.withColumnRenamed("reason", "state"))


def _search(calls):
    return calls.select("env", F.concat(F.lit("found "), F.col("args")["query"]).alias("result"))


@Q("environment_step", "SELECT event_id AS env, CASE event_id % 5 WHEN 0 THEN 'answer' WHEN 1 THEN 'called' WHEN 2 THEN 'unknown' WHEN 3 THEN 'invalid' ELSE 'failed' END AS status, CASE WHEN event_id % 5 = 1 THEN 'found ' || event_type END AS observation, event_id % 5 = 0 AS done FROM events")
def environment_step(spark, d):
    call = lambda tool, args: F.concat(F.lit(f'<tool_call>{{"tool": "{tool}", "args": {{"{args}": "'), F.col("event_type"), F.lit('"}}</tool_call>'))
    forms = [F.col("event_type"), call("search", "query"), call("fly", "query"), F.lit("<tool_call>{</tool_call>"), call("search", "other")]
    actions = read_table(spark, d, "events").select(F.col("event_id").alias("env"), F.coalesce(*(F.when(F.col("event_id") % 5 == k, x) for k, x in enumerate(forms))).alias("action"))
    return A.environment_step(actions, {"search": _search}).select("env", "status", "observation", "done")


@Q("agent_loop", "WITH s AS (SELECT n_nationkey AS env, n_name, unnest(range(0, least(n_nationkey % 5 + 1, 4))) AS step FROM nation) SELECT env, CAST(step AS INT) AS step, CASE WHEN step = env % 5 THEN 'answer' ELSE 'called' END AS status, CASE WHEN step < env % 5 THEN 'found ' || n_name END AS observation FROM s")
def agent_loop(spark, d):
    def policy(active, step):
        call = F.concat(F.lit('<tool_call>{"tool": "search", "args": {"query": "'), F.substring_index("state", "\n", 1), F.lit('"}}</tool_call>'))
        return active.select("env", F.when(F.col("env") % 5 > step, call).otherwise("it is so").alias("action"))

    envs = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("env"), F.col("n_name").alias("state"))
    return A.agent_loop(envs, policy, {"search": _search}, 4).select("env", "step", "status", "observation")


@Q("batch_context", "SELECT c.conv_id, c.turn, CASE WHEN c.turn % 3 = 0 THEN d.source END AS image_id, d.lang AS sources FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def batch_context(spark, d):
    calls = read_table(spark, d, "conversations").select("conv_id", "turn", F.col("conv_id").alias("row"), F.when(F.col("turn") % 3 == 0, "what is <img>").otherwise("what").alias("query"))
    batch = read_table(spark, d, "documents").select(F.col("doc_id").alias("row"), F.col("source").alias("image_id"), F.col("lang").alias("sources"))
    return A.batch_context(calls, batch).select("conv_id", "turn", "image_id", "sources")


@Q("searchable_hyperedges", "SELECT doc_id, doc_id % 3 <> 0 AS active FROM documents WHERE length(trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang END)) > 0")
def searchable_hyperedges(spark, d):
    rows = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("lang")).alias("content"), (F.col("doc_id") % 3 == 0).alias("deleted"))
    live = A.searchable(rows, active=True).select("doc_id", F.lit(True).alias("active"))
    return A.searchable(rows).select("doc_id").join(live, "doc_id", "left").fillna(False, ["active"])


@Q("math_equal", "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM events")
def math_equal(spark, d):
    i = F.col("event_id").cast("string")
    forms = [(F.concat(F.lit("\\frac{"), i, F.lit("}{2}")), F.concat(i, F.lit("/2"))), (F.concat(F.lit("("), i, F.lit(", x+1)")), F.concat(F.lit("("), i, F.lit(".0, 1+x)"))), (F.concat(F.lit("2x + "), i), F.concat(i, F.lit(" + x + x"))), (F.concat(i, F.lit("%")), i), (F.concat(i, F.lit(".5*y")), F.concat(i, F.lit(".5/y"))), (i, (F.col("event_id") * 3 + 1).cast("string"))]
    pick = lambda k: F.coalesce(*(F.when(F.col("event_id") % 6 == n, x[k]) for n, x in enumerate(forms)))
    return read_table(spark, d, "events").select("event_id", M.math_equal(pick(0), pick(1)).alias("hit"))
