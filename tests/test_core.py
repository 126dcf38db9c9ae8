"""Literal fixtures and properties of the core operators."""

import collections
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hyperweave.functions import scores as S
from hyperweave.functions import text as X
from hyperweave.operators import advantages as A
from hyperweave.operators import dataset as D
from hyperweave.operators import graph as G
from hyperweave.operators import joins as J
from hyperweave.operators import kv, merges
from hyperweave.operators import partition as P
from hyperweave.operators import vectors as V
from hyperweave.operators.components import components
from hyperweave.plans import construction as C
from hyperweave.plans import registry
from hyperweave.plans import retrieval as R
from hyperweave.sources import files
from hyperweave.streaming import edits as E


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_reciprocal_rank_fusion(spark):
    a = spark.createDataFrame([("q", 0, "a"), ("q", 1, "b"), ("q", 2, "a")], "query string, i int, knowledge string")
    b = spark.createDataFrame([("q", 0, "b")], "query string, i int, knowledge string")
    got = [(r.knowledge, r.coherence) for r in R.reciprocal_rank_fusion(a, b).orderBy("rank").collect()]
    assert got == [("b", 1.5), ("a", 1.333)]
    assert one(spark, F.bround(F.lit(1 / 16), 3)) == 0.062  # half to even


def test_hybrid_needs_its_mode(spark):
    with pytest.raises(ValueError):
        R.hybrid_query(None, None, None, None, mode="local")


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, " ".join(map(str, range(7)))), (3, " "), (4, None)], "id int, t string")
    got = X.token_chunks(df, "id", "t", 4, 1).orderBy("id", "chunk_order_index").collect()
    assert [(r.id, r.chunk_order_index, r.tokens) for r in got] == [(1, 0, 4), (1, 1, 4), (1, 2, 4), (1, 3, 1), (2, 0, 4), (2, 1, 4), (2, 2, 1)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(2, 9))
def test_chunks_cover_all_tokens(spark, sizes, most):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate(sizes)], "id int, t string")
    seen = {}
    for r in X.token_chunks(df, "id", "t", most, 1).collect():
        seen.setdefault(r.id, set()).update(r.content.split())
    assert all(len(seen.get(k, ())) == n for k, n in enumerate(sizes))


RECORDS = '("hyper-relation"<|>"R1"<|>8)##("entity"<|>"Bob"<|>"person"<|>"d"<|>90)##("entity"<|>"Al"<|>"person"<|>"d"<|>x)'


def test_record_parse(spark):
    df = spark.createDataFrame([("c", RECORDS), ("d", '("entity"<|>"Bob"<|>"p"<|>"d"<|>1)'), ("e", '("hyper-relation"<|>"A"<|>1)##("hyper-relation"<|><|>)##("entity"<|>"X"<|>"t"<|>"d"<|>1)<|COMPLETE|>'), ("f", "no records (a\nb)")], "chunk string, response string")
    got = {(r.chunk, r.kind, r.name, r.weight, r.hyperedge) for r in C.parse_records(df).collect()}
    assert got == {
        ("c", "hyperedge", '<hyperedge>"R1"', 8.0, '<hyperedge>"R1"'), ("c", "entity", '"BOB"', 90.0, '<hyperedge>"R1"'), ("c", "entity", '"AL"', 50.0, '<hyperedge>"R1"'),
        ("e", "hyperedge", '<hyperedge>"A"', 1.0, '<hyperedge>"A"'), ("e", "entity", '"X"', 1.0, '<hyperedge>"A"'),
    }


def test_entity_type_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([("n", t, d, "s", k) for k, (t, d) in enumerate([("geo", "b"), ("person", "a"), ("person", "a"), ("geo", "c")])], "name string, type string, description string, source string, pos int")
    r = merges.merge_entities(df).first()
    assert (r.type, r.description, r.sources) == ("geo", "a<SEP>b<SEP>c", ["s"])


def test_insert_is_idempotent(spark):
    docs = spark.createDataFrame([(" Paris is in France. It has Museums. ",), ("Paris is in France. It has Museums.",), (" ",)], "text string")
    first = C.insert_documents(docs, "text")
    assert first["full_docs"].count() == 1 and first["entities"].count() >= 2 and first["incidence"].count() >= 2
    again = C.insert_documents(docs, "text", first["full_docs"], first["chunks"])
    assert again["chunks"].count() == 0 and again["entities"].count() == 0


def state(spark, rows):
    return spark.createDataFrame([("w", i, c, w, o, x, 0) for i, c, w, o, x in rows], E.STATE)


def edit(spark, held, *tasks):
    rows = [(k, kind, "w", content, new) for k, (kind, content, new) in enumerate(tasks)]
    return E.apply_all(held, spark.createDataFrame(rows, "seq long, update_type string, working_dir string, content string, new_content string"))


def test_soft_delete_and_revival(spark):
    held = state(spark, [(1, "alpha beta gamma delta", 0.8, None, False), (2, "zero", 0.0, None, False)])
    once = edit(spark, held, ("delete", "Alpha  beta gamma delta", None), ("delete", "alpha beta gamma delta", None), ("delete", "zero", None))
    got = {r.id: (r.weight, r.original_weight, r.deleted) for r in once.collect()}
    assert got == {1: (0.4, 0.8, True), 2: (0.05, 0.0, True)}
    back = edit(spark, once, ("update", "alpha beta gamma", "new text"))  # found by containment, though deleted
    r = back.where("id = 1").first()
    assert (r.content, r.weight, r.original_weight, r.deleted) == ("new text", 0.8, None, False)


def test_task_results(spark):
    held = state(spark, [(1, "alpha beta gamma delta", 1.0, None, False)])
    tasks = spark.createDataFrame([(0, "insert", "w", "new one", None), (1, "insert", "w", "NEW one", None), (2, "delete", "w", "nowhere", None), (3, "update", "w", "alpha bet", "x")], "seq long, update_type string, working_dir string, content string, new_content string")
    got = {r.seq: r.status for r in E.task_results(held, E.batched(tasks)).collect()}
    assert got == {0: "succeeded", 1: "skipped", 2: "failed", 3: "failed"}


def test_batches_regroup_by_first_seen_type(spark):
    tasks = spark.createDataFrame([(k, t) for k, t in enumerate(["update", "insert", "update", "delete", "insert"])], "seq long, update_type string")
    assert [r.seq for r in E.batched(tasks).orderBy("batch", "place").collect()] == [0, 2, 1, 4, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "delete" if k % 3 else "update", "w", f"content number {k % 5}", f"content number {k % 5} v{k}") for k in range(12)]
    kind = "seq long, update_type string, working_dir string, content string, new_content string"
    df = spark.createDataFrame(rows, kind).coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    held = state(spark, [(k, f"content number {k}", 1.0, None, False) for k in range(5)])
    versions = [held]
    query = E.stream_edits(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), lambda: versions[-1], lambda s, n: versions.append(s)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, versions[-1].collect()), key=str) == sorted(map(tuple, E.apply_all(held, df).collect()), key=str)


def test_jaccard_is_inclusive(spark):
    asked = spark.createDataFrame([("q", "a b c d"), ("r", "a b c")], "ask string, text string")
    stored = spark.createDataFrame([(1, 0, "A b  c d e"), (2, 1, "a b c d e")], "id int, pos int, content string")
    assert [(r.ask, r.id, r.jaccard) for r in J.jaccard_best(asked, stored).collect()] == [("q", 1, 0.8)]


def test_substring_resolution(spark):
    stored = spark.createDataFrame([(1, 0, "alpha beta gamma delta")], "id int, pos int, content string")
    asked = spark.createDataFrame([("a", "alpha beta gamma"), ("b", "alpha bet"), ("c", "ALPHA beta gamma delta")], "ask string, text string")
    assert {(r.ask, r.how) for r in J.substring_resolve(asked, stored).collect()} == {("a", "contains"), ("c", "exact")}


def test_group_advantages(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 0.0), ("h", 5.0)], "uid string, score double")
    got = sorted((r.uid, r.advantage) for r in A.grpo(df, "uid", "score").collect())
    assert [round(x, 8) for _, x in got] == [-0.70710578, 0.70710578, 4.999995]
    assert sorted(r.advantage for r in A.rloo(df, "uid", "score").collect()) == [-1.0, 1.0, 5.0]


def test_returns_and_gae(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, A.discounted(arr(0.0, 0.0, 1.0), arr(1, 1, 1), 0.5)) == [0.25, 0.5, 1.0]
    r, v, g, lam = [1.0, 0.0, 2.0], [0.5, 0.4, 0.3], 0.9, 0.8
    want, run = [], 0.0
    for t in (2, 1, 0):
        run = r[t] + g * (v[t + 1] if t < 2 else 0.0) - v[t] + g * lam * run
        want.insert(0, run)
    assert all(math.isclose(a, b) for a, b in zip(one(spark, A.gae(arr(*r), arr(*v), g, lam)), want))


def test_masks_and_penalties(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, S.eos_mask(arr(0, 0, 2, 42, 3, 5, 1, 0, 0), 1)) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert one(spark, S.position_ids(arr(0, 0, 1, 1, 1))) == [0, 0, 0, 1, 2]
    kl = spark.createDataFrame([(-1.0, -1.5)], "a double, b double").select(S.kl("low_var_kl", "a", "b").alias("x")).first().x
    assert math.isclose(kl, math.exp(-0.5) + 0.5 - 1)
    assert math.isclose(S.next_beta(0.1, 20.0, 10.0, 100, 10000), 0.1 * (1 + 0.2 * 0.01))
    assert one(spark, S.padded(arr(1, 2, 3), 5, 0, left=True)) == [0, 0, 1, 2, 3]
    row = one(spark, S.sft_row(arr(1, 2), arr(3, 4), 6, 0))
    assert (row.ids, row.mask, row.loss_mask) == ([1, 2, 3, 4, 0, 0], [1, 1, 1, 1, 0, 0], [0, 1, 1, 0, 0, 0])


def test_format_rewards(spark):
    last, call = "<think>t</think>\n<answer>x y</answer>", '<think>t</think>\n<tool_call>{"tool":"search"}</tool_call>'
    golds = F.array(F.lit("x y"))
    assert one(spark, S.format_reward(F.array(F.lit(last)), golds)) == -0.5
    assert one(spark, S.format_reward(F.array(F.lit(call), F.lit(last)), golds)) == 1.0
    assert one(spark, S.format_reward(F.array(F.lit("x")), golds)) == -1.0
    assert one(spark, X.answer_key(F.lit("The  U.S.A., an Apple!"))) == "usa apple"
    assert one(spark, X.answer_parts(F.lit("a|b&&c|a"))) == ["a", "b", "c"]
    assert one(spark, S.token_f1(F.lit("x x y"), F.array(F.lit("x y y")))) == pytest.approx(2 / 3)


def test_observation_spans(spark):
    text = "before<knowledge>search result</knowledge>mid<pipeline>{}</pipeline>after"
    got = [(r.start, r.stop) for r in one(spark, S.masked_spans(F.lit(text), ["knowledge", "pipeline"]))]
    assert [text[a:b] for a, b in got] == ["<knowledge>search result</knowledge>", "<pipeline>{}</pipeline>"]


def test_tool_calls(spark):
    parse = lambda t: one(spark, S.tool_call(F.lit(t)))
    assert parse('x<tool_call>{"tool":"search","args":{"query":"q"}}</tool_call>').tool == "search"
    assert parse('<tool_call>[{"tool":"a","args":{}},{"tool":"b"}]</tool_call>').tool == "a"
    assert parse("<query>old</query>").args == {"query": "old"} and parse("none").tool == "INVALID"
    why = lambda t: one(spark, X.wrong_call(F.lit(t), ["search"]))
    assert [why("x"), why("<tool_call>{"), why("<tool_call>{</tool_call>"), why('<tool_call>{"tool":"x"}</tool_call>'), why('<tool_call>{"tool":"search"}</tool_call>')] == ["no tags", "not closed", "bad JSON", "unknown tool", None]


def test_contract_order_and_state(spark):
    df = spark.createDataFrame([("q", 0, "w1", False, 0.9), ("q", 1, "w1", True, 0.5), ("q", 2, "w2", True, 0.5)], "query string, pos int, content string, active boolean, coherence double").withColumn("weight", F.when(F.col("content") == "w2", 2.0).otherwise(1.0))
    assert [r.pos for r in R.contract_sort(df, ["query"]).orderBy("rank").collect()] == [2, 1, 0]
    known = spark.createDataFrame([("a", False, 3.0), ("a", True, 1.5)], "content string, active boolean, weight double")
    got = R.with_state(spark.createDataFrame([("a",), ("b",)], "content string"), known).orderBy("content").collect()
    assert [(r.active, r.weight) for r in got] == [(True, 1.5), (True, 1.0)]


def test_entity_fusion(spark):
    hits = spark.createDataFrame([("q", "image", "u", 0.5), ("q", "entity", "u", 0.8), ("q", "entity", "u", 0.3), ("q", "hyperedge", "u", 0.4)], "query string, modality string, url string, score double")
    r = R.entity_fusion(hits).first()
    assert r.score == pytest.approx(0.64) and r.sources == ["entity", "hyperedge", "image"] and r.confidence == 1.0


def test_partitions():
    assert P.greedy_partition([1, 9, 1, 1], 2) == [[0, 2, 3], [1]]
    rng = random.Random(0)
    for _ in range(50):
        lengths = [rng.randint(1, 50) for _ in range(12)]
        for equal in (False, True):
            parts = P.differencing_partition(lengths, 3, equal)
            assert sorted(i for p in parts for i in p) == list(range(12)) and (not equal or {len(p) for p in parts} == {4})
    assert P.shard_cover([("a", 5, {1, 2}), ("b", 2, {1}), ("c", 2, {2})], {1, 2}) == ["b", "c"]


def test_upserts(spark):
    old = spark.createDataFrame([("k", 1)], "id string, v int")
    new = spark.createDataFrame([("k", 2), ("j", 3)], "id string, v int")
    assert {(r.id, r.v) for r in kv.insert_if_absent(old, new).collect()} == {("j", 3)}
    assert {(r.id, r.v) for r in kv.upsert_first(old, new).collect()} == {("k", 1), ("j", 3)}
    assert {(r.id, r.v) for r in kv.upsert_last(old, new, "id", "v").collect()} == {("k", 2), ("j", 3)}


def test_promotion(spark):
    matches = spark.createDataFrame([("long enough query", 0, "m")], "query string, pos int, content string")
    recent = spark.createDataFrame([(0, "Long  enough query", True), (1, "a long enough query here", True), (2, "else", True)], "seq int, content string, active boolean")
    got = R.promote_recent(matches, recent, recent.select("content")).orderBy("rank").collect()
    assert [r.content for r in got] == ["Long  enough query", "a long enough query here", "m"]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        up[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: top(x) for a, b in edges if a != b for x in (a, b)}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query string, embedding array<float>")
    assert [(r.id, r.rank) for r in V.top_k(df, q, 2).orderBy("rank").collect()] == [(1, 1), (4, 2)]
    assert V.top_k(df, q, 4, measure="cosine", least=0.5).count() == 3
    r = df.where("id = 2").select(V.quantised("embedding").alias("q")).first().q
    assert r.codes == [0, 255]
    assert V.check_index(df.union(df), dimension=3).first().blockers == ["duplicate ids", "wrong dimension"]


def test_graph_rename_keeps_the_moved_value(spark):
    edges = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("b", "y", 3.0)], "hyperedge string, entity string, weight double")
    got = {(r.hyperedge, r.entity): r.weight for r in G.rename_hyperedges(edges, spark.createDataFrame([("a", "b")], "old string, new string")).collect()}
    assert got == {("b", "x"): 1.0, ("b", "y"): 3.0}
    left = G.delete_nodes(edges, spark.createDataFrame([("x",)], "node string"))
    assert [(r.hyperedge, r.entity) for r in left.collect()] == [("b", "y")]
    ents = spark.createDataFrame([('"X"',)], "entity string")
    quoted = edges.withColumn("entity", F.concat(F.lit('"'), F.upper("entity"), F.lit('"')))
    out = G.delete_by_entity(ents, ents.withColumnRenamed("entity", "node"), quoted, spark.createDataFrame([("x",)], "name string"))
    assert [d.count() for d in out] == [0, 0, 1]


def test_sources(spark, tmp_path):
    import io
    import json
    import tarfile
    import zipfile

    (tmp_path / "kv.json").write_text(json.dumps({"a": {"content": "x"}, "b": {"content": "y"}}))
    assert {r.id: r.value["content"] for r in files.read_json_store(spark, str(tmp_path / "kv.json")).collect()} == {"a": "x", "b": "y"}
    nodes = [("A", {"role": "entity", "note": "<x>\r\n\t\"y\""}), ("b & c", None), ("d\ne", {})]
    edges = [("A", "b & c", 0.5, {"why": "&amp; 'so'"}), ("A", "d\ne", None, None)]
    n = spark.createDataFrame(nodes, "node string, data map<string,string>").repartition(3)
    files.write_graphml(n, spark.createDataFrame(edges, "source string, target string, weight double, data map<string,string>"), str(tmp_path / "graph"))
    (tmp_path / "broken.graphml").write_text("<graphml")
    n, e = files.read_graphml(spark, f"{tmp_path}/{{graph/part-*,broken.graphml}}")
    assert {(r.node, tuple(sorted(r.data.items()))) for r in n.collect()} == {(k, tuple(sorted((d or {}).items()))) for k, d in nodes}
    assert {(r.source, r.target, r.weight, r.data.get("why")) for r in e.collect()} == {("A", "b & c", 0.5, "&amp; 'so'"), ("A", "d\ne", 0.0, None)}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("p.json", "{}")
        z.writestr("p.png", "png")
    with tarfile.open(tmp_path / "b.tar", "w") as t:
        info = tarfile.TarInfo("q.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"[]"))
    got = files.read_archive_members(spark, str(tmp_path / "[ab].*"), (".json", ".png"))
    assert {r.member for r in got.collect()} == {"p.json", "p.png", "q.json"} and files.paired_members(got).count() == 1
    with pytest.raises(Exception, match="p.json has 2 bytes"):
        files.read_archive_members(spark, str(tmp_path / "a.zip"), most=1).collect()
    files.write_csv(spark.createDataFrame([("1", 'a "q"\nb')], "id string, t string"), str(tmp_path / "csv"), ["t", "missing"])
    back = files.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["t", "missing", "id"] and back.first().t == 'a "q"\nb'
    d = files.synthetic_splits(spark)
    for s in ("train", "test"):
        d.where(F.col("split") == s).drop("split").write.parquet(str(tmp_path / s))
    assert [r.split for r in files.read_splits(spark, {"test": str(tmp_path / "test"), "train": str(tmp_path / "train")}, limit=3).collect()] == ["train", "train", "test"]
    with pytest.raises(ValueError):
        files.read_splits(spark, {"train": "x"})
    files.write_json_lines(d, str(tmp_path / "jl"))
    assert files.read_json_lines(spark, str(tmp_path / "jl")).count() == 4


def test_validation(spark):
    rows = spark.createDataFrame([("kb", "train", 0, "q", ["a", " a", ""], "i", " ", ["c"])], "dataset string, split string, index int, question string, golden_answers array<string>, image_id string, image_path string, context array<string>")
    r = D.validate_records(D.mm_record(rows)).first()
    assert r.violations == ["image_path is blank"] and r.data_id == "kb:train:0:i" and r.extra_info.golden_answers == ["a"]
    q = D.qa_record(rows.withColumn("answer", F.lit("a")), "Answer: ").first()
    assert q.prompt[0].content == "Answer: q" and q.reward_model.ground_truth == ["a"]


def test_math_answers(spark):
    df = spark.createDataFrame([(r"so \boxed{\frac12} and \boxed{\frac{1}{2}}", "1/2"), ("none", "1")], "x string, y string")
    assert [r.m for r in df.select(S.boxed_match("x", "y").alias("m")).collect()] == [1.0, 0.0]
    assert one(spark, S.number_match(F.lit("about 1,234.0"), F.lit("1234"))) == 1.0


def test_registry(spark):
    @registry.tool("count_rows")
    def count_rows(df: object, least: int = 0):
        return df.where(F.col("id") >= least)

    t = registry.get("count_rows")
    assert t.check({}) == "missing df" and t.check({"df": 1, "least": "x"}) == "least is no int" and t.check([]) and t(df=spark.range(4), least=2).count() == 2
    with pytest.raises(KeyError):
        registry.get("nothing")


def test_results_do_not_depend_on_partitions(spark):
    rows = [(k % 7, f"t{k % 5}", float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, text string, s double")
    shuffled = spark.createDataFrame(random.Random(1).sample(rows, 60), "g int, text string, s double").repartition(7)
    for f in (lambda d: merges.fingerprint(d, "text"), lambda d: A.batch_metrics(d, ["s"], ["g"])):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(shuffled).collect()))


def test_entry_without_the_corpus_operators():
    import subprocess
    import sys
    import tempfile
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(f"{root}/hyperweave", f"{d}/hyperweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", d)
        code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=d, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_distributed_numbers_and_totals(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(50)) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, v int").repartition(5)
    places = {r.id: r.place for r in P.numbered(df, "v", "id").collect()}
    assert places == {k: i for i, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    totals = {r.id: r.total for r in P.running_total(df, "v", "id").collect()}
    assert totals == {k: sum(v for j, v in rows if j <= k) for k, _ in rows}
    batch = spark.createDataFrame([(k, k % 3 == 0) for k in range(9)], "row int, active boolean")
    got = J.scatter(batch, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "i long, value string"), "row", "value", "-").orderBy("row").collect()
    assert "".join(r.value for r in got) == "a--b--c--"


def test_arguments_for_every_row_or_each(spark):
    rows = spark.createDataFrame([(0,), (1,)], "row int")
    all_rows = J.broadcast_args(rows, spark.createDataFrame([(0, "x")], "pos int, v string"), "row")
    assert sorted((r.row, r.v) for r in all_rows.collect()) == [(0, "x"), (1, "x")]
    each = J.broadcast_args(rows, spark.createDataFrame([(0, "x"), (1, "y")], "pos int, v string"), "row")
    assert sorted((r.row, r.v) for r in each.collect()) == [(0, "x"), (1, "y")]


def test_masked_spans_pair_by_place(spark):
    spans = lambda t: [(r.start, r.stop) for r in one(spark, S.masked_spans(F.lit(t), ["k"]))]
    assert spans("a<k>b<k>c</k>d</k>e") == [(1, 13), (5, 18)]
    assert spans("x</k>y<k>z</k>") == [(6, 5)]  # covers nothing
    assert spans("<k>") == spans("") == []
    assert one(spark, S.masked_spans(F.lit(None).cast("string"), ["k"])) is None


def test_returns_of_long_trajectories(spark):
    n = 20000
    got = one(spark, A.discounted(F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(1), n), 0.5))
    assert len(got) == n and got[-3:] == [1.75, 1.5, 1.0]
    rows = spark.createDataFrame([("a", 2, 1.0, "x"), ("a", 1, 2.0, "y"), ("b", 1, 3.0, "z")], "t string, pos int, r double, other string")
    assert {(r.other, r.returns) for r in A.reward_to_go(rows, "t", "pos", "r", 0.5).collect()} == {("x", 1.0), ("y", 2.5), ("z", 3.0)}
    empty = spark.createDataFrame([], "r array<double>, m array<int>").select(A.discounted(F.col("r"), F.col("m"), 0.5))
    assert empty.count() == 0 and one(spark, A.discounted(F.array().cast("array<double>"), F.array().cast("array<int>"), 0.5)) == []


def test_promotion_keeps_the_newest(spark):
    matches = spark.createDataFrame([("some long query", 0, "m")], "query string, pos int, content string")
    recent = spark.createDataFrame([(k, f"some long query {k}", True) for k in range(300)], "seq int, content string, active boolean")
    got = [r.content for r in R.promote_recent(matches, recent, recent.select("content")).orderBy("rank").collect()]
    assert got == [f"some long query {k}" for k in range(299, 43, -1)] + ["m"]


def test_walks_reach_every_neighbour(spark):
    star = spark.createDataFrame([("hub", f"e{k}", 1.0) for k in range(4)], "hyperedge string, entity string, weight double")
    seen = {r.node for seed in range(40) for r in G.random_walks(star, 1, seed).where("start = 'hub' AND step = 1").collect()}
    assert seen == {"e0", "e1", "e2", "e3"}


def test_edits_of_many_batches(spark):
    state = spark.createDataFrame([], E.STATE)
    rows = [(k, "insert", f"w{k % 3}", f"fact {k % 60}", None) for k in range(120)]
    rows += [(120 + k, "delete", f"w{k % 3}", f"fact {k}", None) for k in range(0, 60, 2)]
    tasks = spark.createDataFrame(rows, "seq long, update_type string, working_dir string, content string, new_content string")
    got = E.apply_all(state, tasks, size=10).collect()
    assert {(r.working_dir, r.content, r.deleted, r.weight) for r in got} == {(f"w{k % 3}", f"fact {k}", k % 2 == 0, 0.5 if k % 2 == 0 else 1.0) for k in range(60)} and len(got) == 60


@pytest.mark.parametrize("measure", ["ip", "cosine"])
def test_best_holds_a_block_of_scores(measure):
    """The scores of all queries by all rows of a batch are never held at once."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(2500, 8)), rng.normal(size=(10_000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(v))), pa.array(v.tolist(), pa.list_(pa.float32()))], ["id", "embedding"])
    tracemalloc.start()
    got = {}
    for part in V._best([batch], list(range(len(q))), q, 3, "id", measure, 0.1):
        for r in part.to_pylist():
            got.setdefault(r["query"], []).append((-r["score"], r["id"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all scores are 200 MB
    w = v.astype(float)
    if measure == "cosine":
        q, w = q / np.linalg.norm(q, axis=1)[:, None], w / np.linalg.norm(w, axis=1)[:, None]
    for k in range(0, len(q), 50):
        assert [i for _, i in sorted(got[k])] == list(np.argsort(-(w @ q[k]))[:3])


def test_fallback_counts_are_those_of_the_matches(spark):
    build = spark.createDataFrame([(k % 3, f"t{k % 4}", k) for k in range(20)], "url int, title string, s int")
    probe = spark.createDataFrame([(c, c % 6, f"t{c % 7}") for c in range(40)], "row int, url int, title string")
    made = lambda spread: J.fallback_join(build, probe, "url", "title", "row", spread)
    rows = sorted((r.row, r.match_key, r.b_s) for r in made(1).collect())
    assert rows == sorted((r.row, r.match_key, r.b_s) for r in made(5).collect())
    assert rows == sorted([(c, "url", k) for c in range(40) for k in range(20) if c % 6 == k % 3] + [(c, "title", k) for c in range(40) for k in range(20) if c % 6 > 2 and c % 7 == k % 4])
    counts = {(r.row, r.match_key): r.n for r in J.fallback_counts(build, probe, "url", "title", "row").collect()}
    assert counts == {key: sum(x[:2] == key for x in rows) for key in {x[:2] for x in rows}}


def test_fallback_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """The probe's few splits had made all pairs, however many. Lists and parts are bounded, also where rows are equal."""
    monkeypatch.setattr(J, "LIST", 8, raising=False)
    monkeypatch.setattr(J, "PAIRS", 256, raising=False)
    near = [(k % 2 if k % 9 else None, f"t{k % 3}", k if k < 80 else 80) for k in range(120)]
    far = [(c, c % 4 if c % 11 else None, f"t{c % 5}" if c % 7 else None) for c in range(400)]
    build = spark.createDataFrame(near, "url int, title string, s int")
    got = J.fallback_join(build, spark.createDataFrame(far, "row int, url int, title string"), "url", "title", "row", 2)
    want = collections.Counter((c, u, t, *b, "url") for c, u, t in far for b in near if u == b[0] and u is not None)
    met = {x[0] for x in want}
    want += collections.Counter((c, u, t, *b, "title") for c, u, t in far if c not in met for b in near if t == b[1])
    assert got.columns == ["row", "url", "title", "b_url", "b_title", "b_s", "match_key"]
    made = got.rdd.glom().map(lambda rows: [tuple(r) for r in rows]).collect()
    assert collections.Counter(r for rows in made for r in rows) == want
    assert max(map(len, made)) < want.total() / 6
    none = J.fallback_join(build.limit(0), build.select(F.col("s").alias("row"), "url", "title"), "url", "title", "row", 2)
    assert none.collect() == []


def test_entities_read_their_mentions_once(spark):
    """Types and descriptions had each run the whole extraction."""
    from hyperweave.operators import merges

    rows = [("A", "x", "d2", "s1", "1"), ("A", "y", "d1", "s2", "0"), ("A", "x", "d1", "s1", "2"), ("B", "q", None, "s1", "4"), ("B", None, "e", "s3", "3"), (None, "x", "d", "s", "5")]
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            runs.add(len(frame))
            yield frame

    kinds = "name string, type string, description string, source string, pos string"
    got = merges.merge_entities(spark.createDataFrame(rows, kinds).mapInPandas(counted, kinds)).collect()
    assert {r.name: (r.type, r.description, r.sources) for r in got} == {"A": ("x", "d1<SEP>d2", ["s1", "s2"]), "B": (None, "e", ["s1", "s3"])}
    assert runs.value == len(rows)
