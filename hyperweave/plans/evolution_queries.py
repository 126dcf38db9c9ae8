"""Queries of the evolution plane: edits as folds, logs, caches and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import query_key
from ..operators import merges
from ..streaming import edits as E
from .base import Catalogue, read_table

Q = Catalogue()


def _log(spark, d):
    e = read_table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), "update").when(F.col("event_type") == "error", "delete").otherwise("insert")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("h"), (F.col("event_id") % 977).cast("string")).alias("id"), kind.alias("action"), F.concat(F.lit("text "), (F.col("event_id") % 1303).cast("string")).alias("content"), F.col("value").alias("weight"))


_LOG = "lg AS (SELECT event_id AS seq, 'h' || (event_id % 977) AS id, CASE WHEN event_type IN ('view', 'click') THEN 'update' WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS action, 'text ' || (event_id % 1303) AS content, value AS weight FROM events)"


@Q("mutation_fold", f"WITH {_LOG} SELECT id, arg_max(action, seq) AS action, arg_max(content, seq) AS content, arg_max(action <> 'delete', seq) AS active, max(seq) AS seq, count(*) AS n FROM lg GROUP BY id")
def mutation_fold(spark, d):
    log = _log(spark, d)
    return E.latest_state(E.mutation_log(log, "seq", "action", "id", F.col("content"), F.col("action") != "delete"))


@Q("recent_mutations", f"WITH {_LOG}, t AS (SELECT * FROM lg ORDER BY seq DESC LIMIT 256), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM t) SELECT seq, id, action, content, weight, CAST(row_number() OVER (ORDER BY seq DESC) AS INT) AS place FROM k WHERE r = 1")
def recent(spark, d):
    return merges.recent(_log(spark, d), "seq", "id")


@Q("soft_delete_weights", f"WITH {_LOG}, s AS (SELECT id, arg_min(weight, seq) AS w, count(*) FILTER (action = 'delete') AS n FROM lg GROUP BY id) SELECT id, CASE WHEN n = 0 THEN w WHEN w > 0 THEN w / 2 ELSE 0.05 END AS weight FROM s")
def soft_delete(spark, d):
    s = _log(spark, d).groupBy("id").agg(F.min_by("weight", "seq").alias("w"), F.count_if(F.col("action") == "delete").alias("n"))
    return s.select("id", E.soft_deleted(F.col("w"), F.col("n")).alias("weight"))


@Q("edit_batches", f"WITH {_LOG}, b AS (SELECT seq, action, (row_number() OVER (ORDER BY seq) - 1) // 50 AS batch FROM lg), f AS (SELECT *, min(seq) OVER (PARTITION BY batch, action) AS f FROM b) SELECT seq, action AS update_type, CAST(batch AS BIGINT) AS batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY f, seq) AS INT) AS place FROM f")
def edit_batches(spark, d):
    return E.batched(_log(spark, d).select("seq", F.col("action").alias("update_type")))


def _edits(spark, d):
    """A batch of edits for every language's store of benchmark-like contents."""
    n = read_table(spark, d, "nation")
    state = n.select(F.concat(F.lit("w"), F.col("n_regionkey").cast("string")).alias("working_dir"), F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("content of "), F.lower("n_name")).alias("content"), (F.col("n_nationkey") % 4).cast("double").alias("weight"), F.lit(None).cast("double").alias("original_weight"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("changed"))
    tasks = state.select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "update").otherwise("delete").alias("update_type"), "working_dir", "content", F.concat("content", F.lit(" new")).alias("new_content"))
    return state, tasks


@Q("edit_fold", "SELECT 'w' || n_regionkey AS working_dir, CAST(n_nationkey AS BIGINT) AS id, 'content of ' || lower(n_name) || CASE WHEN n_nationkey % 3 = 0 THEN ' new' ELSE '' END AS content, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey % 4 AS DOUBLE) WHEN n_nationkey % 4 > 0 THEN (n_nationkey % 4) / 2.0::DOUBLE ELSE 0.05 END AS weight, n_nationkey % 3 <> 0 AS deleted FROM nation")
def edit_fold(spark, d):
    return E.apply_all(*_edits(spark, d)).select("working_dir", "id", "content", "weight", "deleted")


@Q("edit_results", "SELECT CAST(n_nationkey AS BIGINT) AS seq, 'succeeded' AS status, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def edit_results(spark, d):
    state, tasks = _edits(spark, d)
    return E.task_results(state, E.batched(tasks))


_STREAMED = "WITH s AS (SELECT 'w' || s_nationkey AS working_dir, CAST(s_suppkey AS BIGINT) AS id, 'content of ' || lower(s_name) AS c FROM supplier)"


@Q("edit_stream", _STREAMED + " SELECT working_dir, id, c || CASE WHEN id % 3 = 0 THEN ' new' ELSE '' END AS content, CASE WHEN id % 3 = 0 THEN CAST(id % 4 AS DOUBLE) WHEN id % 4 > 0 THEN (id % 4) / 2.0::DOUBLE ELSE 0.05 END AS weight, id % 3 <> 0 AS deleted FROM s")
def edit_stream(spark, d):
    """Existing records, then an update or a delete of each, as a keyed stateful stream; the flushes laid over the base."""
    from ..session import scratch
    from ..streaming import stateful

    state = read_table(spark, d, "supplier").select(F.concat(F.lit("w"), F.col("s_nationkey").cast("string")).alias("working_dir"), F.col("s_suppkey").cast("long").alias("id"), F.concat(F.lit("content of "), F.lower("s_name")).alias("content"), (F.col("s_suppkey") % 4).cast("double").alias("weight"), F.lit(None).cast("double").alias("original_weight"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("changed"))
    loads, path = stateful.load_rows(state), scratch(spark, "edits")
    kind = F.when(F.col("id") % 3 == 0, "update").otherwise("delete")
    null = {c: F.lit(None).cast(t) for c, t in loads.dtypes if c in ("weight", "original_weight", "deleted")}
    tasks = state.select("working_dir", F.col("id").alias("seq"), kind.alias("update_type"), "content", F.concat("content", F.lit(" new")).alias("new_content"), F.lit(None).cast("long").alias("id")).withColumns(null)
    for part, rows in (("0", loads), ("1", tasks)):
        rows.coalesce(1).write.parquet(f"{path}/{part}")
    stream = spark.readStream.schema(loads.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    out = E.drain(stateful.stream_tasks(stream, seconds=None), mode="update")
    return stateful.latest(state, out).select("working_dir", "id", "content", "weight", "deleted")


@Q("websearch_cache_hits", r"WITH k AS (SELECT event_id, lower(trim(regexp_replace('  Query ' || (event_id % 311) || ' x ', '\s+', ' ', 'g'))) AS query_key, '  Query ' || (event_id % 311) || ' x ' AS t FROM events) SELECT query_key, arg_min(t, event_id) AS original, count(*) - 1 AS hit_count, min(event_id) AS created, max(event_id) AS updated FROM k GROUP BY 1")
def cache_hits(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.concat(F.lit("  Query "), (F.col("event_id") % 311).cast("string"), F.lit(" x ")).alias("t"))
    return E.cache_hits(e, "event_id", "t")


@Q("llm_cache", "WITH s AS (SELECT q.vec_id AS query, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id), r AS (SELECT query, id, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS r FROM s) SELECT query, id FROM r WHERE r = 1 AND s > 0.95")
def llm_cache(spark, d):
    """Each query's answer is taken from the prompt most like it, where that is like enough; its own entry does not count."""
    from ..operators.vectors import top_k

    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    best = top_k(e, e.where("id % 50 = 0").select(F.col("id").alias("query"), "embedding"), 2, measure="cosine").where("id <> query")
    best = best.groupBy("query").agg(F.min_by(F.struct("id", "score"), "rank").alias("x"))
    return best.where("x.score > 0.95").select("query", "x.id")


@Q("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windows(spark, d):
    return E.windowed_counts(read_table(spark, d, "events"), "ts", "event_type", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q("stream_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    path = f"{d}/events.parquet"
    kind = spark.read.parquet(path).schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counted = E.windowed_counts(stream, "ts", "event_type", "1 hour", late="40 days")
    return E.drain(counted, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q("stream_mutations", f"WITH {_LOG} SELECT id, count(*) AS n, max(seq) AS seq FROM lg GROUP BY id")
def stream_mutations(spark, d):
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d)
    state = stream.groupBy(F.concat(F.lit("h"), (F.col("event_id") % 977).cast("string")).alias("id")).agg(F.count("*").alias("n"), F.max("event_id").alias("seq"))
    return E.drain(state, "complete")


@Q("lookup_by_key", r"SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, count(*) AS n FROM benchmark GROUP BY 1")
def lookup(spark, d):
    return read_table(spark, d, "benchmark").groupBy(query_key("text").alias("key")).agg(F.count("*").alias("n"))
