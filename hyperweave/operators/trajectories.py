"""The agent's plane: environment steps, turns, metrics of batches, queues of edits, plans and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import tool_call
from ..session import settled
from .kv import first_per_key
from .partition import numbered

Tool = Callable[[DataFrame], DataFrame]


def environment_step(actions: DataFrame, tools: dict[str, Tool]) -> DataFrame:
    """actions: (env, action). (env, tool, status, observation, done): every action's first call is run by its tool, all
    calls of a tool at once. A tool takes (env, args) and gives (env, result). An action without a call is done; a call
    that cannot be read is invalid, one of a tool that is not there unknown, one without a result failed."""
    calls = actions.withColumn("call", tool_call("action"))
    asks = F.col("action").contains("<tool_call>") | F.col("action").contains("<query>")
    known = F.col("call.tool").isin(list(tools))
    status = F.when(~asks, "answer").when(F.col("call.tool") == "INVALID", "invalid").when(known, "called").otherwise("unknown")
    # settled: what follows asks for the calls once for each tool and once more, and each time they would be parsed again
    calls = settled(calls.select("env", F.when(asks, F.col("call.tool")).alias("tool"), F.col("call.args").alias("args"), status.alias("status")))
    results = None
    for name, tool in tools.items():
        mine = tool(calls.where((F.col("status") == "called") & (F.col("tool") == name)).select("env", "args")).select("env", F.col("result").cast("string").alias("result"))
        results = mine if results is None else results.unionByName(mine)
    if results is None:
        results = calls.where(F.lit(False)).select("env", F.lit("").alias("result"))
    done = F.col("status") == "answer"
    status = F.when((F.col("status") == "called") & F.col("result").isNull(), "failed").otherwise(F.col("status"))
    return calls.join(results, "env", "left").select("env", "tool", status.alias("status"), F.col("result").alias("observation"), done.alias("done"))


def agent_loop(envs: DataFrame, policy: Callable[[DataFrame, int], DataFrame], tools: dict[str, Tool], turns: int) -> DataFrame:
    """envs: (env, state). (env, step, action, tool, status, observation): in each of at most `turns` turns the policy
    gives the actions of the environments that still call tools, as (env, action); what they observed is appended to
    their state. The turns of one environment depend on each other, so they are settled one after the other."""
    active, out = envs.select("env", "state"), None
    for step in range(turns):
        acted = settled(policy(active, step).select("env", "action"))
        done = settled(acted.join(environment_step(acted, tools), "env").withColumn("step", F.lit(step)))
        out = done if out is None else out.unionByName(done)
        going = done.where(~F.col("done"))
        if going.isEmpty():
            break
        seen = going.select("env", F.concat_ws("\n", "action", F.coalesce("observation", "status")).alias("__seen"))
        active = settled(active.join(seen, "env").select("env", F.concat_ws("\n", "state", "__seen").alias("state")))
    return out.select("env", "step", "action", "tool", "status", "observation")


def batch_context(calls: DataFrame, batch: DataFrame, key: str = "row") -> DataFrame:
    """calls: (row, query), batch: (row, image_id, sources). The calls with their row's context; the image reaches only
    queries that hold <img>."""
    joined = calls.join(batch.select(key, "image_id", "sources"), key, "left")
    return joined.withColumn("image_id", F.when(F.col("query").contains("<img>"), F.col("image_id")))


def token_metrics(df: DataFrame, values: list[str], prompt_mask: str, response_mask: str, explained: tuple[str, str] | None = None) -> DataFrame:
    """One row: mean, max and min of each array column's valid tokens, of its sums by row, and of the prompts' and
    responses' lengths, with the share of rows that fill all places; explained: (returns, values) for the explained variance."""
    total = lambda a: F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x.cast("double"))
    three = lambda x, name: [f(x).alias(f"{name}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    rows = df.select(*(total(v).alias(f"{v}_row") for v in values), *(total(m).alias(n) for m, n in ((prompt_mask, "prompt_length"), (response_mask, "response_length"))),
                     *(F.size(m).alias(f"{n}_places") for m, n in ((prompt_mask, "prompt_length"), (response_mask, "response_length"))))
    lengths = ("prompt_length", "response_length")
    places = rows.agg(*(F.max(f"{n}_places").alias(f"{n}_most") for n in lengths))
    by_row = rows.join(F.broadcast(places)).agg(
        *(x for n in [f"{v}_row" for v in values] + list(lengths) for x in three(F.col(n), n)),
        *(F.avg((F.col(n) == F.col(f"{n}_most")).cast("double")).alias(f"{n}_clip_ratio") for n in lengths),
    )
    tokens = df.select(F.explode(F.arrays_zip(*values, response_mask)).alias("t")).where(F.col("t")[response_mask] == 1).select("t.*")
    of_tokens = [x for v in values for x in three(F.col(v), v)]
    if explained:
        returns, predicted = map(F.col, explained)
        of_tokens.append((1 - F.var_samp(returns - predicted) / (F.var_samp(returns) + 1e-5)).alias("explained_variance"))
    return by_row.join(F.broadcast(tokens.agg(*of_tokens)))


def fold_batch(df: DataFrame, groups: int, *order: Column | str) -> DataFrame:
    """Rows in their order, cut into `groups` blocks of one size: (block, at). An error if they do not divide."""
    rows = numbered(df, *order, into="__place")
    size = rows.agg((F.count("*") / groups).alias("__size"))
    whole = F.when(F.col("__size") == F.floor("__size"), F.col("__size").cast("long")).otherwise(F.raise_error(F.lit(f"rows do not divide into {groups}")).cast("long"))
    cut = rows.join(F.broadcast(size.select(whole.alias("__size"))))
    return cut.withColumn("block", F.floor(F.col("__place") / F.col("__size"))).withColumn("at", F.col("__place") % F.col("__size")).drop("__place", "__size")


def unfold_batch(df: DataFrame) -> DataFrame:
    """The rows of fold_batch in their order again."""
    return df.orderBy("block", "at").drop("block", "at")


def padded_responses(df: DataFrame, ids: str, most: int, pad: int) -> DataFrame:
    """Id arrays filled up behind to the longest of all, and cut at `most`."""
    longest = df.agg(F.least(F.coalesce(F.max(F.size(ids)), F.lit(0)), F.lit(most)).alias("__n"))
    cut = F.slice(F.col(ids), F.lit(1), F.col("__n"))
    return df.join(F.broadcast(longest)).withColumn(ids, F.concat(cut, F.array_repeat(F.lit(pad), F.col("__n") - F.size(cut)))).drop("__n")


def queue_stats(results: DataFrame, seq: str, status: str, keep: int = 20) -> DataFrame:
    """(status, n, last): the tasks of every status and the newest `keep` of them, newest first."""
    ranked = results.withColumn("__r", F.row_number().over(Window.partitionBy(status).orderBy(F.desc(seq)))).where(F.col("__r") <= keep)
    last = ranked.groupBy(status).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", seq))), lambda x: x[seq]).alias("last"))
    return results.groupBy(status).agg(F.count("*").alias("n")).join(last, status).withColumnRenamed(status, "status")


def due(tasks: DataFrame, step: int, train_step: str = "train_step") -> tuple[DataFrame, DataFrame]:
    """Deferred tasks that the end of a training step applies, those without a step among them, and those that wait on."""
    now = F.coalesce(F.col(train_step) <= step, F.lit(True))
    return tasks.where(now), tasks.where(~now)


def transfer_plan(cover: DataFrame, size: str, shards: int, transfer: int, mirror: int) -> DataFrame:
    """One row for the shards that cover a selection: planned, bytes, blockers. A cover of `mirror` shards or more nears
    the whole mirror; a blocked plan plans nothing."""
    found = cover.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0).cast("long")).alias("bytes"))
    rules = [(F.col("n") >= mirror, "near_full_mirror"), (F.col("n") > shards, "max_shards_exceeded"), (F.col("bytes") > transfer, "max_transfer_exceeded")]
    blockers = F.filter(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)), lambda x: x.isNotNull())
    return found.withColumn("blockers", blockers).select(F.when(F.size("blockers") == 0, F.col("n")).otherwise(0).alias("planned"), "bytes", "blockers")


def copied_stats(items: DataFrame, present: DataFrame, root: str, samples: int = 10) -> DataFrame:
    """items: (index, image_id, path); present: (path). (state, n, samples): how many copied files are there, missing, or
    outside the subset's folder, with the first of each by index."""
    inside = F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    known = present.select("path").distinct().withColumn("__known", F.lit(True))
    state = F.when(~F.coalesce(inside, F.lit(False)), "outside").when(F.col("__known"), "present").otherwise("missing")
    marked = items.join(known, "path", "left").withColumn("state", state)
    first = marked.withColumn("__r", F.row_number().over(Window.partitionBy("state").orderBy("index"))).where(F.col("__r") <= samples)
    sampled = first.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("index", "image_id", "path"))).alias("samples"))
    return marked.groupBy("state").agg(F.count("*").alias("n")).join(sampled, "state")


def format_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """hits: (query, modality, id, score, rank); records: (id, content, deleted, active, weight). Hits with what is known
    of them; a hit without a record is active, weighs 1 and stands for itself."""
    r = records.select("id", "content", "deleted", "active", "weight")
    deleted = F.coalesce("deleted", F.lit(False))
    return hits.join(r, "id", "left").select(
        "query", "id", "modality", "rank", "score",
        F.coalesce("content", F.col("id").cast("string")).alias("knowledge"), deleted.alias("deleted"),
        F.coalesce("active", ~deleted).alias("active"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    )


def merged_candidates(reports: DataFrame) -> DataFrame:
    """reports: (report, pos, value). Every value at its first place over all reports: (value, rank) from 1."""
    first = reports.groupBy("value").agg(F.min(F.struct("report", "pos")).alias("__at"))
    return numbered(first, F.col("__at"), F.col("value")).select("value", (F.col("place") + 1).alias("rank"))


def selected_ids(rows: DataFrame, source: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """rows: (pos, source, image_id). The distinct ids of a source that fit the pattern, by first place, and the others of
    the source as blockers: (pos, image_id, reason)."""
    mine = rows.where(F.col("source") == source)
    fits = F.coalesce(F.col("image_id").rlike(pattern), F.lit(False))
    good = first_per_key(mine.where(fits), ["image_id"], [F.col("pos")]).select("pos", "image_id")
    return good, mine.where(~fits).select("pos", "image_id", F.lit("invalid_image_id").alias("reason"))


def searchable(hyperedges: DataFrame, active: bool = False) -> DataFrame:
    """Hyperedges with a content that is not blank; active: without deleted ones."""
    kept = hyperedges.where(F.length(F.trim("content")) > 0)
    return kept.where(~F.coalesce("deleted", F.lit(False))) if active else kept
