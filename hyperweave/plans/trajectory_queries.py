"""Queries of the trajectory plane: calls, scores, advantages, penalties and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import advantages as A
from ..operators.joins import spread_join
from .base import Catalogue, read_table

Q = Catalogue()


def _scored(spark, d):
    """Labelled documents: groups are languages and sources, the score is quality less half of toxicity."""
    j = read_table(spark, d, "labels").join(read_table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return j.select("doc_id", "lang", "source", F.concat_ws("/", "lang", "source").alias("uid"), (F.col("quality") - 0.5 * F.col("toxic")).cast("double").alias("score"))


_SCORED = "s AS (SELECT l.doc_id, lang, source, lang || '/' || source AS uid, CAST(quality - 0.5 * toxic AS DOUBLE) AS score FROM labels l JOIN documents USING (doc_id))"


@Q("grpo_advantage", f"WITH {_SCORED}, w AS (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS m, stddev_samp(score) OVER g AS sd FROM s WINDOW g AS (PARTITION BY uid)) SELECT doc_id, uid, round(CASE WHEN n > 1 THEN (score - m) / (sd + 1e-6) ELSE score / (1 + 1e-6) END, 6) AS advantage FROM w")
def grpo(spark, d):
    return A.grpo(_scored(spark, d), "uid", "score").select("doc_id", "uid", F.round("advantage", 6).alias("advantage"))


@Q("rloo_advantage", f"WITH {_SCORED}, w AS (SELECT *, count(*) OVER g AS n, avg(score) OVER g AS m FROM s WINDOW g AS (PARTITION BY uid)) SELECT doc_id, uid, round(CASE WHEN n > 1 THEN score * n / (n - 1) - m * n / (n - 1) ELSE score END, 6) AS advantage FROM w")
def rloo(spark, d):
    return A.rloo(_scored(spark, d), "uid", "score").select("doc_id", "uid", F.round("advantage", 6).alias("advantage"))


def _steps(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 500).cast("string")).alias("traj"), F.col("event_id").alias("pos"), (F.col("event_id") % 5 - 2).cast("double").alias("reward"), (F.col("event_type") != "error").cast("int").alias("mask"), "value")


_STEPS = "st AS (SELECT event_id, user_id || '-' || CAST(event_id // 500 AS BIGINT) AS traj, event_id AS pos, CAST(event_id % 5 - 2 AS DOUBLE) AS reward, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS mask, value FROM events)"


@Q("remax_advantage", f"WITH {_STEPS} SELECT event_id, sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS returns, sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.25 * mask AS advantage FROM st")
def remax(spark, d):
    s = _steps(spark, d).withColumn("base", F.lit(0.25))
    return A.remax(s, "traj", "pos", "reward", "mask", "base").select("event_id", "returns", "advantage")


@Q("discounted_returns", f"WITH {_STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY pos) AS r FROM st) SELECT a.event_id, round(sum(b.reward * pow(0.9, b.r - a.r)), 6) AS returns FROM o a JOIN o b ON a.traj = b.traj AND b.r >= a.r GROUP BY 1")
def discounted(spark, d):
    s = _steps(spark, d)
    return A.reward_to_go(s, "traj", "pos", "reward", 0.9).select("event_id", F.round("returns", 6).alias("returns"))


def _arrays(spark, d):
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(c).alias("v")))), lambda x: x["v"])
    return _steps(spark, d).groupBy("traj").agg(order("reward").alias("rewards"), order("mask").alias("masks"), order("value").alias("vals"))


@Q("reinforce_pp_returns", f"""WITH RECURSIVE {_STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY pos DESC) AS r FROM st), f(traj, r, ret, run) AS (SELECT traj, r, reward, reward * mask FROM o WHERE r = 1 UNION ALL SELECT o.traj, o.r, o.reward + 0.9 * f.run, (o.reward + 0.9 * f.run) * o.mask FROM f JOIN o ON o.traj = f.traj AND o.r = f.r + 1) SELECT traj, CAST(count(*) AS INT) AS n, round(sum(ret), 9) AS total FROM f GROUP BY traj""")
def reinforce(spark, d):
    a = _arrays(spark, d).withColumn("r", A.discounted(F.col("rewards"), F.col("masks"), 0.9))
    return a.select("traj", F.size("r").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@Q("gae_advantage", f"""WITH RECURSIVE {_STEPS}, o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY pos DESC) AS r, reward + 0.99 * coalesce(lead(value / 7.0::DOUBLE) OVER (PARTITION BY traj ORDER BY pos), 0) - value / 7.0::DOUBLE AS delta FROM st), f(traj, r, a) AS (SELECT traj, r, delta FROM o WHERE r = 1 UNION ALL SELECT o.traj, o.r, o.delta + 0.99 * 0.95 * f.a FROM f JOIN o ON o.traj = f.traj AND o.r = f.r + 1) SELECT traj, CAST(count(*) AS INT) AS n, round(sum(a), 6) AS total FROM f GROUP BY traj""")
def gae(spark, d):
    a = _arrays(spark, d).withColumn("a", A.gae(F.col("rewards"), F.transform("vals", lambda v: v / 7.0), 0.99, 0.95))
    return a.select("traj", F.size("a").alias("n"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@Q("masked_whiten", f"WITH {_STEPS}, m AS (SELECT avg(value) FILTER (mask = 1) AS m, var_samp(value) FILTER (mask = 1) AS v FROM st) SELECT event_id, round((value - m) / sqrt(v + 1e-8) * mask, 6) + 0.0 AS whitened FROM st, m")
def whiten(spark, d):
    return A.whitened(_steps(spark, d), "value", "mask").select("event_id", (F.round("whitened", 6) + 0.0).alias("whitened"))


@Q("masked_moments", f"WITH {_STEPS} SELECT round(sum(value) FILTER (mask = 1), 4) AS sum, round(avg(value) FILTER (mask = 1), 6) AS mean, round(var_samp(value) FILTER (mask = 1), 4) AS var, count(*) FILTER (mask = 1) AS n FROM st")
def moments(spark, d):
    m = A.masked_moments(_steps(spark, d), "value", "mask")
    return m.select(F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"), "n")


@Q("kl_penalty", "WITH k AS (SELECT event_id, -value / 100 AS lp, -(event_id % 7) / 3.0::DOUBLE AS ref FROM events) SELECT event_id, round(lp - ref, 9) AS kl, round(abs(lp - ref), 9) AS abs_kl, round(0.5 * (lp - ref) * (lp - ref), 9) AS mse, round(greatest(-10, least(10, exp(ref - lp) + (lp - ref) - 1)), 9) AS low_var FROM k")
def kl(spark, d):
    k = read_table(spark, d, "events").select("event_id", (-F.col("value") / 100).alias("lp"), (-(F.col("event_id") % 7) / F.lit(3.0)).alias("ref"))
    return k.select("event_id", *(F.round(S.kl(x, "lp", "ref"), 9).alias(n) for x, n in (("kl", "kl"), ("abs", "abs_kl"), ("mse", "mse"), ("low_var_kl", "low_var"))))


@Q("kl_shaped_rewards", f"WITH {_STEPS} SELECT event_id, round(reward - 0.05 * (value / 100) * mask, 6) AS reward FROM st")
def shaped(spark, d):
    s = A.shaped(_steps(spark, d).withColumn("kl", F.col("value") / 100).withColumnRenamed("reward", "score"), "score", "kl", "mask", 0.05)
    return s.select("event_id", F.round("reward", 6).alias("reward"))


@Q("batch_metrics", f"WITH {_SCORED} SELECT round(avg(score), 6) AS score_mean, max(score) AS score_max, min(score) AS score_min FROM s")
def metrics(spark, d):
    return A.batch_metrics(_scored(spark, d), ["score"]).withColumn("score_mean", F.round("score_mean", 6))


@Q("per_source_metrics", f"WITH {_SCORED} SELECT source, round(avg(score), 6) AS score_mean, max(score) AS score_max, min(score) AS score_min FROM s GROUP BY source")
def source_metrics(spark, d):
    return A.batch_metrics(_scored(spark, d), ["score"], ["source"]).withColumn("score_mean", F.round("score_mean", 6))


@Q("bootstrap_metrics", """WITH a AS (SELECT source, doc_id // 200 AS problem, doc_id AS i, (doc_id % 11) / 10.0::DOUBLE AS s, lang AS a FROM documents),
g AS (SELECT source, problem, list({'s': s, 'a': a} ORDER BY i) AS x, count(*) AS n FROM a GROUP BY 1, 2),
d AS (SELECT source, problem, k, list_transform(range(k), lambda j: x[1 + CAST('0x' || substr(md5(concat_ws(':', '42', problem, k, b, j)), 1, 8) AS BIGINT) % n]) AS y FROM g, (VALUES (2), (4), (8)) t(k), range(1000) r(b)),
v AS (SELECT source, problem, k, list_max(list_transform(y, lambda v: v.s)) AS best, list_min(list_transform(y, lambda v: v.s)) AS worst, list_max(list_transform(y, lambda v, p: {'n': len(list_filter(y, lambda o: o.a = v.a)), 'p': -p, 's': v.s})).s AS maj FROM d),
m AS (SELECT source, problem, 'mean' AS metric, CAST(count(*) AS INT) AS size, avg(s) AS mean, stddev_pop(s) AS std FROM a GROUP BY 1, 2 UNION ALL SELECT source, problem, 'best', k, avg(best), stddev_pop(best) FROM v GROUP BY 1, 2, k UNION ALL SELECT source, problem, 'worst', k, avg(worst), stddev_pop(worst) FROM v GROUP BY 1, 2, k UNION ALL SELECT source, problem, 'maj', k, avg(maj), stddev_pop(maj) FROM v GROUP BY 1, 2, k)
SELECT source, metric, size, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std FROM m GROUP BY 1, 2, 3""")
def bootstrap(spark, d):
    rows = read_table(spark, d, "documents").select("source", F.expr("doc_id div 200").alias("problem"), "doc_id", (F.col("doc_id") % 11 / 10.0).alias("score"), "lang")
    found = A.bootstrap_metrics(rows, "source", "problem", "doc_id", "score", "lang")
    return found.select("source", "metric", "size", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@Q("reward_manager", """WITH t AS (SELECT item_id, ['exact', 'part', 'other'][item_id % 3 + 1] AS source, item_id % 5 AS n, text FROM benchmark),
s AS (SELECT *, CASE source WHEN 'exact' THEN CASE WHEN item_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END WHEN 'part' THEN 1.0 ELSE 0.5 END AS score FROM t)
SELECT item_id, source, score, list_transform(range(5), lambda j: CASE WHEN j = CASE WHEN n > 0 THEN n - 1 ELSE 4 END THEN score ELSE 0.0::DOUBLE END) AS reward FROM s""")
def manager(spark, d):
    from ..operators.rewards import reward_manager

    source = F.element_at(F.array(*map(F.lit, ("exact", "part", "other"))), (F.col("item_id") % 3 + 1).cast("int"))
    start = F.when(source == "part", "it is ").when(F.col("item_id") % 2 == 1, "not ").otherwise("")
    mask = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: (j < F.col("item_id") % 5).cast("int"))
    rows = read_table(spark, d, "benchmark").select("item_id", source.alias("source"), F.concat(start, "text").alias("response"), F.array("text").alias("golds"), mask.alias("mask"))
    scored = reward_manager(rows, {"exact": S.exact_match, "part": S.contains_match}, "source", "response", "golds", "mask", default=lambda r, g: F.lit(0.5))
    return scored.select("item_id", "source", "score", "reward")


@Q("explained_variance", f"WITH {_STEPS} SELECT round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 4) AS explained_variance FROM st")
def explained(spark, d):
    return A.explained_variance(_steps(spark, d), "reward", "value").select(F.round("explained_variance", 4).alias("explained_variance"))


@Q("pass_at_k", f"WITH {_SCORED} SELECT avg(h) AS pass_at_k FROM (SELECT CASE WHEN max(score) = 1 THEN 1.0::DOUBLE ELSE 0 END AS h FROM s GROUP BY uid)")
def pass_k(spark, d):
    return A.pass_at_k(_scored(spark, d), "uid", "score")


_WORDS = r"string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' ')"


@Q("token_f1", rf"""WITH t AS (SELECT item_id, list_filter({_WORDS}, lambda x: x <> '') AS w FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS x, b.w AS y FROM t a JOIN t b ON b.item_id % 5 = a.item_id % 5),
u AS (SELECT a, b, unnest(list_distinct(x)) AS v, x, y FROM p), c AS (SELECT a, b, sum(least(len(list_filter(x, lambda q: q = v)), len(list_filter(y, lambda q: q = v)))) AS n, any_value(len(x) + len(y)) AS s FROM u GROUP BY 1, 2)
SELECT a, b, round(2.0::DOUBLE * n / s, 6) AS f1 FROM c""")
def token_f1(spark, d):
    """Every item as an answer to all items of its residue; words are counted once for each text."""
    t = read_table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 5).alias("k"), S.answer_counts("text").alias("n"))
    a, b = t.select("k", F.col("item_id").alias("a"), F.col("n").alias("x")), t.select("k", F.col("item_id").alias("b"), F.col("n").alias("y"))
    return spread_join(a, b, "k", "a").select("a", "b", F.round(S.f1_of_counts("x", "y"), 6).alias("f1"))


def _turns(spark, d):
    c = read_table(spark, d, "conversations")
    call = F.concat(F.lit("<think>t</think>\n<tool_call>"), F.to_json(F.struct(F.col("role").alias("tool"), F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("query")).alias("args"))), F.lit("</tool_call>"))
    answer = F.concat(F.lit("<think>t</think>\n<answer>"), F.concat(F.lit("The c"), F.col("conv_id").cast("string"), F.lit("!")), F.lit("</answer>"))
    return c.select("conv_id", "turn", "role", call.alias("call"), answer.alias("answer"))


@Q("tool_call_parse", "SELECT conv_id, turn, role AS tool, 'c' || conv_id AS query, 'c' || conv_id AS answer_key FROM conversations")
def tool_parse(spark, d):
    from ..functions.text import answer_key, answer_of

    t = _turns(spark, d).withColumn("c", S.tool_call("call"))
    return t.select("conv_id", "turn", F.col("c.tool").alias("tool"), F.col("c.args")["query"].alias("query"), answer_key(answer_of("answer")).alias("answer_key"))


@Q("format_reward", "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN n = 1 THEN -0.5::DOUBLE ELSE 1.0 END AS reward, 1.0::DOUBLE AS em FROM n")
def format_reward(spark, d):
    w = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    t = _turns(spark, d).withColumn("r", w).withColumn("block", F.when(F.col("r") == 1, F.col("answer")).otherwise(F.col("call")))
    b = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]).alias("b"))
    golds = F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("zzz"))
    from ..functions.text import answer_of

    return b.select("conv_id", S.format_reward("b", golds).alias("reward"), S.exact_match(answer_of(F.element_at("b", -1)), golds).alias("em"))


@Q("observation_mask", """WITH w AS (SELECT row_number() OVER () AS n, conv_id, turn, role || '<knowledge>' || text || '</knowledge>after' AS x FROM conversations),
p AS (SELECT n, conv_id, turn, t, string_split(x, t) AS g FROM w, (VALUES ('<knowledge>'), ('</knowledge>')) v(t)),
u AS (SELECT n, conv_id, turn, t, unnest(g) AS part, generate_subscripts(g, 1) AS i, len(g) AS size FROM p),
a AS (SELECT *, sum(length(part) + length(t)) OVER (PARTITION BY n, t ORDER BY i) AS past FROM u)
SELECT o.conv_id, o.turn, CAST(o.past - 11 AS INT) AS start, CAST(s.past AS INT) AS stop FROM a o JOIN a s ON o.n = s.n AND o.i = s.i AND o.t = '<knowledge>' AND s.t = '</knowledge>' AND o.i < o.size AND s.i < s.size""")
def observation(spark, d):
    c = read_table(spark, d, "conversations")
    whole = F.concat("role", F.lit("<knowledge>"), "text", F.lit("</knowledge>after"))
    return c.select("conv_id", "turn", F.explode(S.masked_spans(whole, ["knowledge"])).alias("s")).select("conv_id", "turn", "s.start", "s.stop")


@Q("eos_mask", "SELECT event_id, CAST(event_id % 7 + 1 AS INT) AS kept FROM events")
def eos(spark, d):
    ids = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.when(i >= F.col("event_id") % 7, 1).otherwise(5))
    return read_table(spark, d, "events").select("event_id", F.aggregate(S.eos_mask(ids, 1), F.lit(0), lambda s, x: s + x).alias("kept"))


@Q("pad_truncate", "SELECT event_id, CASE WHEN event_id % 9 >= 5 THEN 0 ELSE CAST(5 - event_id % 9 AS INT) END AS pads, 5 AS size FROM events")
def pad(spark, d):
    ids = F.slice(F.array(*[F.lit(7)] * 9), 1, (F.col("event_id") % 9).cast("int"))
    p = S.padded(ids, 5, 0, left=True)
    return read_table(spark, d, "events").select("event_id", F.size(F.filter(p, lambda x: x == 0)).alias("pads"), F.size(p).alias("size"))


@Q("number_match", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS hit FROM events")
def number(spark, d):
    text = F.concat(F.lit("first 3, then "), (F.col("event_id") + F.col("event_id") % 2).cast("string"), F.lit("."))
    return read_table(spark, d, "events").select("event_id", S.number_match(text, F.col("event_id").cast("string")).alias("hit"))


@Q("flops_estimate", "SELECT sum(n_chars) AS tokens, sum(n_chars::DOUBLE * n_chars) AS squares, sum(n_chars) * 2.0 + sum(n_chars::DOUBLE * n_chars) * 3.0 AS flops FROM documents")
def flops(spark, d):
    return S.flops(read_table(spark, d, "documents"), "n_chars", 2.0, 3.0)


@Q("entropy_from_logits", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT vec_id, list_sum(list_transform(v, lambda x: exp(x))) AS z, list_sum(list_transform(v, lambda x: exp(x) * x)) AS s, v[3] AS third FROM e) SELECT vec_id, round(ln(z) - s / z, 6) AS entropy, round(third - ln(z), 6) AS log_prob FROM z")
def entropy(spark, d):
    e = read_table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.round(S.entropy("v"), 6).alias("entropy"), F.round(S.log_prob("v", F.lit(2)), 6).alias("log_prob"))


@Q("turn_counts", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS actions FROM conversations GROUP BY 1")
def turns(spark, d):
    return read_table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("actions"))


_LOSS = "ls AS (SELECT event_id, -value / 100 AS o, -value / 100 + (event_id % 11 - 5) / 10.0::DOUBLE AS n, CAST(event_id % 5 - 2 AS DOUBLE) AS a, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS m, value FROM events)"


def _losses(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", (-F.col("value") / 100).alias("o"), (-F.col("value") / 100 + (F.col("event_id") % 11 - 5) / 10.0).alias("n"), (F.col("event_id") % 5 - 2).cast("double").alias("a"), (F.col("event_type") != "error").cast("int").alias("m"), "value")


@Q("policy_loss", f"WITH {_LOSS}, r AS (SELECT *, exp(n - o) AS r FROM ls), c AS (SELECT *, -a * r AS p, greatest(-a * r, -a * greatest(0.8, least(1.2, r))) AS c FROM r) SELECT round(sum(c * m) / sum(m), 6) AS loss, round(sum(CASE WHEN c > p THEN m ELSE 0 END)::DOUBLE / sum(m), 6) AS clip_fraction, round(sum((o - n) * m) / sum(m), 6) AS kl FROM c")
def policy_loss(spark, d):
    r = A.policy_loss(_losses(spark, d), "o", "n", "a", "m")
    return r.select(*(F.round(x, 6).alias(x) for x in r.columns))


@Q("value_loss", f"WITH {_LOSS}, c AS (SELECT m, pow(n - a, 2) AS x, pow(greatest(o - 0.2, least(o + 0.2, n)) - a, 2) AS y FROM ls) SELECT round(0.5 * sum(greatest(x, y) * m) / sum(m), 6) AS loss FROM c")
def value_loss(spark, d):
    return A.value_loss(_losses(spark, d), "n", "o", "a", "m").select(F.round("loss", 6).alias("loss"))


@Q("state_coverage", f"WITH {_LOSS} SELECT sum(m) AS tokens, round(sum(m)::DOUBLE / count(*), 6) AS coverage FROM ls")
def state_coverage(spark, d):
    return A.state_coverage(_losses(spark, d).withColumn("one", F.lit(1)), "m", "one").withColumn("coverage", F.round("coverage", 6))


@Q("timing_metrics", "SELECT event_type, round(sum(value), 4) AS seconds, sum(event_id % 100) AS tokens, round(sum(value) * 1000 / nullif(sum(event_id % 100), 0), 4) AS ms_per_token FROM events GROUP BY 1")
def timing(spark, d):
    t = A.timing(read_table(spark, d, "events").withColumn("tokens", F.col("event_id") % 100), "event_type", "value", "tokens")
    return t.select("event_type", F.round("seconds", 4).alias("seconds"), "tokens", F.round("ms_per_token", 4).alias("ms_per_token"))


@Q("first_call_prefix", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '</tool_call>' ELSE role END AS kept FROM conversations")
def first_call(spark, d):
    c = read_table(spark, d, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit("</tool_call> more </tool_call>"))).otherwise(F.col("role"))
    return c.select("conv_id", "turn", S.until_first_call(text).alias("kept"))


@Q("token_runs", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [1, 2] ELSE [1, 8, 9, 2] END AS ids FROM events")
def token_runs(spark, d):
    ids = F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(7), (F.col("event_id") % 4).cast("int")), F.array(F.lit(2)))
    return read_table(spark, d, "events").select("event_id", S.runs_replaced(ids, 7, [8, 9]).alias("ids"))


@Q("trajectory_totals", "SELECT conv_id, count(*) AS turns, round(sum(CASE WHEN turn % 3 = 0 THEN 0.9::DOUBLE ELSE 1 END), 6) AS reward FROM conversations GROUP BY 1")
def totals(spark, d):
    from .training import trajectory_totals

    t = read_table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("action"), (F.col("turn") % 3 != 0).alias("valid"), F.lit(True).alias("effective"), F.lit(1.0).alias("reward"))
    return trajectory_totals(t, "conv_id", "turn").select("conv_id", "turns", F.round("reward", 6).alias("reward"))


@Q("batched_generation", "SELECT conv_id, list(text ORDER BY turn) AS responses FROM conversations GROUP BY 1")
def generation(spark, d):
    from .training import collected

    return collected(read_table(spark, d, "conversations"), "conv_id", "text", "turn")


@Q("tool_arguments", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing query' WHEN event_id % 3 = 1 THEN 'k is no number' END AS fault FROM events")
def tool_arguments(spark, d):
    args = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("k"), F.lit("1"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("query"), F.lit("q"), F.lit("k"), F.lit("x"))).otherwise(F.create_map(F.lit("query"), F.lit("q"), F.lit("k"), F.lit("2.5")))
    return read_table(spark, d, "events").select("event_id", S.args_violation(args, ["query"], ["k"]).alias("fault"))
