"""The agent's plane on small tables: nulls, empty tables, ties and bounds."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyperweave.functions import mathematics as M
from hyperweave.functions import records as R
from hyperweave.functions.text import latex_normalised
from hyperweave.operators import trajectories as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_safe(spark):
    nan, inf = float("nan"), float("inf")
    kind = "struct<a:double,l:array<float>,m:map<string,double>,s:struct<t:timestamp>>"
    rows = spark.createDataFrame([((nan, [1.0, -inf, None], {"k": inf, "z": 2.0}, None),), (None,)], f"x {kind}")
    got = [r.x for r in rows.select(R.json_safe("x", T._parse_datatype_string(kind)).alias("x")).collect()]
    assert got[1] is None and got[0].a is None and got[0].l == [1.0, None, None] and got[0].m == {"k": None, "z": 2.0} and got[0].s is None


def test_page_fields(spark):
    assert one(spark, R.page_url(F.lit('{"source_row": {"wikipedia_url": "", "evidence_page_url": " e "}}'))) == "e"
    assert one(spark, R.page_url(F.lit('{"source_rows": [{"evidence_page_url": "e"}]}'))) is None
    assert one(spark, R.page_title(F.lit(None).cast("string"))) is None and one(spark, R.page_title(F.lit("{broken"))) is None


def test_rewards(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, R.reward_at_last(F.lit(1.5), arr(1, 1, 0))) == [0.0, 1.5, 0.0]
    assert one(spark, R.reward_at_last(F.lit(1.5), arr(0, 0))) == [0.0, 1.5]
    pair = one(spark, R.reward_pair(arr(1, 2), arr(3), arr(4, 5, 6), 4, eos=9))
    assert pair.ids == [[1, 2, 3, 9], [1, 2, 4, 5]] and pair.mask == [[1] * 4] * 2
    pair = one(spark, R.reward_pair(arr(1), arr(2), F.array().cast("array<int>"), 3))
    assert pair.ids == [[1, 2, 0], [1, 0, 0]] and pair.mask == [[1, 1, 0], [1, 0, 0]]


def test_environment_step(spark):
    call = '<tool_call>{"tool": "%s", "args": {"query": "%s"}}</tool_call>'
    actions = [(1, call % ("up", "a")), (2, call % ("low", "B")), (3, call % ("gone", "x")), (4, "<tool_call>nothing</tool_call>"), (5, "the end"), (6, "<query>old</query>")]
    upper = lambda d: d.select("env", F.upper(F.col("args")["query"]).alias("result"))
    lower = lambda d: d.select("env", F.lower(F.col("args")["query"]).alias("result"))
    got = {r.env: (r.status, r.observation, r.done) for r in A.environment_step(spark.createDataFrame(actions, "env int, action string"), {"up": upper, "low": lower}).collect()}
    assert got == {1: ("called", "A", False), 2: ("called", "b", False), 3: ("unknown", None, False), 4: ("invalid", None, False), 5: ("answer", None, True), 6: ("unknown", None, False)}
    assert {r.status for r in A.environment_step(spark.createDataFrame(actions, "env int, action string"), {}).collect()} == {"unknown", "invalid", "answer"}


def test_agent_loop(spark):
    envs = spark.createDataFrame([(k, f"s{k}") for k in range(3)], "env int, state string")
    call = F.concat(F.lit('<tool_call>{"tool": "size", "args": {"query": "'), F.size(F.split("state", "\n")).cast("string"), F.lit('"}}</tool_call>'))
    policy = lambda active, step: active.select("env", F.when(F.col("env") > step, call).otherwise("done").alias("action"))
    tool = lambda d: d.select("env", F.col("args")["query"].alias("result"))
    got = sorted((r.env, r.step, r.status, r.observation) for r in A.agent_loop(envs, policy, {"size": tool}, 5).collect())
    # each turn appends the action and its observation to the state
    assert got == [(0, 0, "answer", None), (1, 0, "called", "1"), (1, 1, "answer", None), (2, 0, "called", "1"), (2, 1, "called", "3"), (2, 2, "answer", None)]
    assert A.agent_loop(envs.where("env < 0"), policy, {"size": tool}, 2).count() == 0


def test_token_metrics(spark):
    rows = spark.createDataFrame([([1.0, 3.0], [1.0, 1.0], [1, 1], [1, 0]), ([5.0, 100.0], [4.0, 0.0], [1, 0], [0, 0])], "s array<double>, v array<double>, m array<int>, p array<int>")
    m = A.token_metrics(rows, ["s", "v"], "p", "m", ("s", "v")).first()
    assert (m.s_mean, m.s_max, m.s_min, m.s_row_max) == (3.0, 5.0, 1.0, 105.0)
    assert (m.response_length_mean, m.response_length_clip_ratio, m.prompt_length_max, m.prompt_length_clip_ratio) == (1.5, 0.5, 1.0, 0.0)
    assert abs(m.explained_variance - (1 - 1.0 / (4.0 + 1e-5))) < 1e-9
    assert A.token_metrics(rows.where("size(s) = 0"), ["s"], "p", "m").first().s_mean is None


def test_batches(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "k int")
    folded = A.fold_batch(rows, 2, "k")
    assert {(r.k, r.block, r["at"]) for r in folded.collect()} == {(k, k // 3, k % 3) for k in range(6)}
    assert [r.k for r in A.unfold_batch(folded).collect()] == list(range(6))
    with pytest.raises(Exception, match="do not divide"):
        A.fold_batch(rows, 4, "k").collect()
    ids = spark.createDataFrame([(1, [1, 2, 3]), (2, [1]), (3, [])], "k int, ids array<int>")
    assert {r.k: r.ids for r in A.padded_responses(ids, "ids", 2, 0).collect()} == {1: [1, 2], 2: [1, 0], 3: [0, 0]}
    assert A.padded_responses(ids.where("k < 0"), "ids", 2, 0).count() == 0


def test_reports(spark):
    results = spark.createDataFrame([(k, "ok" if k % 2 else "failed") for k in range(9)], "seq int, status string")
    assert {r.status: (r.n, r.last) for r in A.queue_stats(results, "seq", "status", 2).collect()} == {"ok": (4, [7, 5]), "failed": (5, [8, 6])}
    now, later = A.due(spark.createDataFrame([(1,), (2,), (None,)], "train_step int"), 1)
    assert now.count() == 2 and later.count() == 1  # a task without a step is due
    shards = spark.createDataFrame([(10,), (20,)], "size int")
    assert A.transfer_plan(shards, "size", 2, 30, 3).first() == (2, 30, [])
    assert A.transfer_plan(shards, "size", 1, 29, 2).first() == (0, 30, ["near_full_mirror", "max_shards_exceeded", "max_transfer_exceeded"])
    assert A.transfer_plan(shards.where("size < 0"), "size", 1, 1, 1).first() == (0, 0, [])
    items = spark.createDataFrame([(0, "a", "r/a"), (1, "b", "r/b"), (2, "c", "r/../c"), (3, "d", None), (4, "e", "rr/e")], "index int, image_id string, path string")
    stats = {r.state: (r.n, [s["index"] for s in r.samples]) for r in A.copied_stats(items, items.where("image_id = 'a'").select("path"), "r/", 2).collect()}
    assert stats == {"present": (1, [0]), "missing": (1, [1]), "outside": (3, [2, 3])}


def test_selections(spark):
    reports = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "a")], "report int, pos int, value string")
    assert {(r.value, r.rank) for r in A.merged_candidates(reports).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    rows = spark.createDataFrame([(0, "x", "i1"), (1, "x", None), (2, "x", "i1"), (3, "y", "i2"), (4, "x", "!")], "pos int, source string, image_id string")
    good, bad = A.selected_ids(rows, "x", r"^\w+$")
    assert [tuple(r) for r in good.collect()] == [(0, "i1")] and {r.pos for r in bad.collect()} == {1, 4}
    hits = spark.createDataFrame([("q", "text", "a", 0.5, 1), ("q", "text", "b", 0.4, 2)], "query string, modality string, id string, score double, rank int")
    records = spark.createDataFrame([("a", "A", True, None, None)], "id string, content string, deleted boolean, active boolean, weight double")
    got = {r.id: (r.knowledge, r.deleted, r.active, r.weight) for r in A.format_hits(hits, records).collect()}
    assert got == {"a": ("A", True, False, 1.0), "b": ("b", False, True, 1.0)}
    edges = spark.createDataFrame([("x", True), ("y", None), (" ", False), (None, False)], "content string, deleted boolean")
    assert A.searchable(edges).count() == 2 and [r.content for r in A.searchable(edges, active=True).collect()] == ["y"]
    calls = spark.createDataFrame([(1, "see <img>"), (1, "see"), (2, "<img>")], "row int, query string")
    batch = spark.createDataFrame([(1, "i1", "s")], "row int, image_id string, sources string")
    assert sorted(str(r.image_id) for r in A.batch_context(calls, batch).collect()) == ["None", "None", "i1"]


def test_math_equal(spark):
    same = [("1,234", "1234"), ("50%", "0.5"), ("0.5", "50"), ("\\frac{1}{2}", "1/2"), ("(1, 2)", "(1.0,2)"), ("[0, 2x]", "[0, x+x]"), ("x^2-1", "(x-1)(x+1)"), ("2\\sqrt{2}", "\\sqrt{8}"), ("\\pi/4", "0.785398"), ("y = 3x", "x*3"), ("-2^2", "-4"), ("$5$", "5"), ("Yes", "yes"), ("2^{-1}", "1/2")]
    other = [("x+1", "x-1"), ("1", "3"), ("(1,2)", "(2,1)"), ("", "0"), ("1/0", "2/0"), ("__import__('os')", "1"), ("(" * 900, "1"), ("9^9^9^9", "1"), ("(1,2)", "1"), ("x" * 2000, "y"), ("\\unknown{2}", "2"), (None, "1"), ("1", None), ("a b", ""), ("A", "a"), ("(1,2]", "[1,2)")]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(same + other)], "k int, a string, b string")
    got = {r.k: r.hit for r in rows.select("k", M.math_equal("a", "b").alias("hit")).collect()}
    assert [k for k in range(len(same)) if got[k] != 1.0] == [] and [(k, other[k - len(same)]) for k in got if k >= len(same) and got[k] != 0.0] == []


def test_short_answers_in_one_form(spark):
    pairs = [("0.5", "\\frac{1}{2}"), ("x = .5", "\\frac{1}{2}"), ("3\n4", "34"), ("\\\\frac12", "\\frac{1}{2}"), ("{.25}", "{0.25}"), ("1 .5", "10.5"), ("abc=4", "abc=4"), ("10\\text{ cm}", "10"), ("7\\%", "7")]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "k int, a string")
    got = {r.k: r.x for r in rows.select("k", latex_normalised("a").alias("x")).collect()}
    assert [got[k] for k in range(len(pairs))] == [b for _, b in pairs]


def test_environment_step_parses_once(spark):
    """Every tool's side and the join had parsed all actions again."""
    rows = [(1, '<tool_call>{"tool": "t", "args": {"query": "x"}}</tool_call>'), (2, "done")]
    tool = lambda calls: calls.select("env", F.col("args")["query"].alias("result"))
    got = A.environment_step(spark.createDataFrame(rows, "env int, action string"), {"t": tool, "u": tool})
    assert "get_json_object" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.env, r.status, r.observation) for r in got.collect()} == {(1, "called", "x"), (2, "answer", None)}
