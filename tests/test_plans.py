"""Composite plans, payloads, tables and versions."""

import collections
import re
import string

import pytest
from pyspark.sql import functions as F

from hyperweave.functions import payloads as L
from hyperweave.operators import partition as P
from hyperweave.operators import vectors as V
from hyperweave.plans import catalogue, search, training
from hyperweave.sources import tables
from hyperweave.streaming.versions import Versions


def test_text_search(spark):
    encode = V.hash_encoder(64)
    names = spark.createDataFrame([("paris",), ("london",)], "name string")
    hyper = spark.createDataFrame([("paris is nice",), ("london is big",)], "name string")
    vec = lambda d: d.select(F.col("name").alias("id"), encode(F.col("name")).alias("embedding"))
    edges = spark.createDataFrame([("paris is nice", "paris", 1.0), ("london is big", "london", 2.0), ("london is big", "paris", 1.0)], "hyperedge string, entity string, weight double")
    nodes = edges.groupBy("hyperedge").agg(F.sum("weight").alias("weight"))
    state = spark.createDataFrame([("paris is nice", True, 1.0), ("london is big", False, 0.5)], "content string, active boolean, weight double")
    recent = spark.createDataFrame([(0, "paris is nice", True)], "seq int, content string, active boolean")
    got = search.text_search(spark.createDataFrame([("paris",)], "query string"), encode, vec(names), vec(hyper), edges, nodes, state, recent, 1, 1).orderBy("rank").collect()
    assert [(r.content, r.active) for r in got] == [("paris is nice", True), ("london is big", False)] and got[0].coherence == 1.0
    alone = search.without_graph(spark.createDataFrame([("paris",)], "query string"), encode, vec(names), vec(hyper)).collect()
    assert {r["name"] for r in alone} >= {"paris", "paris is nice"}


def test_routed_search(spark):
    q = spark.createDataFrame([("a", "words", None), ("b", "<img>", "img1"), ("c", "<img>", None)], "id string, query string, image_id string")
    v = spark.createDataFrame([(i, m, [1.0, 0.0]) for i in "ab" for m in ("image", "entity", "hyperedge")], "id string, modality string, embedding array<float>")
    index = lambda url, x: spark.createDataFrame([(url, url, [x, 0.0])], "id string, url string, embedding array<float>")
    got = search.routed_search(q, {"image": index("u", 0.5), "entity": index("u", 0.8), "hyperedge": index("u", 0.4)}, v)
    assert {r["query"]: (round(r.score, 6), r.route) for r in got.collect()} == {"a": (0.54, "text"), "b": (1.7, "visual_entity")}


def test_training_step(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 0.0)], "uid string, s double")
    rows = training.step(df, F.col("s"), F.lit(0.0), "uid")
    assert sorted(round(r.advantage, 4) for r in rows.collect()) == [-0.7071, 0.7071] and training.step_metrics(rows).first().score_mean == 0.5
    turns = spark.createDataFrame([("t", 0, "a", True, True, 1.0), ("t", 1, "b", False, False, 0.0)], "traj string, pos int, action string, valid boolean, effective boolean, reward double")
    r = training.trajectory_totals(turns, "traj", "pos").first()
    assert (r.turns, r.actions, r.reward) == (2, ["a", "b"], 0.9)
    assert [r.copy for r in training.prompts(spark.range(2).withColumnRenamed("id", "pos"), 2, "pos").orderBy("place").collect()] == [0, 1, 0, 1]
    with pytest.raises(ValueError):
        training.step(df, F.col("s"), F.lit(0.0), "uid", estimator="x")


def test_payloads(spark):
    df = spark.createDataFrame([("q", f"e{k // 2}", k, "p") for k in range(14)], "q string, e string, k int, path string")
    assert [r.e for r in L.compact_images(df, "q", "e", "k", ["e", "path"]).orderBy("place").collect()] == ["e0", "e1", "e2"]
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert [(r.knowledge, r.coherence) for r in one(L.coerced_results(F.lit('["a","b"]')))] == [("a", 0.5), ("b", 0.5)]
    assert [(r.knowledge, r.coherence) for r in one(L.coerced_results(F.lit('[{"knowledge":"a","coherence":0.9},{"knowledge":"b"}]')))] == [("a", 0.9), ("b", 0.5)]
    got = L.exploded_contents(spark.createDataFrame([('["a"," ","b"]',), ("plain",)], "raw string"), "raw").collect()
    assert [r.content for r in got] == ["a", "b", "plain"]
    assert one(L.manifest_violations(F.lit('{"version":1,"dataset":"d","status":"complete","requested":2,"complete":1,"images":1}'), "d")) == ["subset incomplete"]
    assert L.protected_violations(["data/raw/x", "out"], ["data/raw"]) == ["data/raw/x"]
    e = spark.createDataFrame([("d1",), ("d2",), ("",)], "dataset string")
    assert [r.x for r in e.select(L.scope_error(e, {"dataset": "d1"}).alias("x")).collect()] == [None, "dataset is not loaded", None]
    assert one(L.prompt("a {x} b", x=F.lit(1))) == "a 1 b" and one(L.json_kind(F.lit("[1]"))) == "array"
    nested = spark.createDataFrame([((1, 2), 3)], "s struct<keep:int,image_path:int>, image_path int")
    assert L.without_fields(nested, ["image_path"]).first().asDict(True) == {"s": {"keep": 1}}
    rm = spark.createDataFrame([((["g"],), (["h"],))], "extra_info struct<golden_answers:array<string>>, reward_model struct<ground_truth:array<string>>")
    assert rm.select(L.golden_answers(rm).alias("x")).first().x == ["g"]


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<float>")
    assert tables.write_index(df, str(tmp_path / "ix"), {"provider": "hash"})["count"] == 2
    vectors, blockers = tables.load_index(spark, str(tmp_path / "ix"), 3)
    assert vectors.count() == 2 and blockers == ["store count differs"]
    with pytest.raises(ValueError):
        tables.write_index(df.union(df), str(tmp_path / "bad"))
    new = spark.createDataFrame([("a", "x"), ("c", "y")], "id string, content string")
    assert tables.encode_upsert(df, new, V.hash_encoder(2)).count() == 3
    assert tables.query_one(spark, "SELECT :x + 1 AS y", x=1) == {"y": 2}


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "kb"))
    assert v.current() is None
    assert v.commit({"t": spark.range(2)}) == 0
    with pytest.raises(ValueError):
        v.commit({"t": spark.range(0)}, lambda s, n: ["empty"] if s.read("t", n).isEmpty() else [])
    assert v.current() == 0 and v.read("t").count() == 2
    assert v.commit({"t": spark.range(3)}) == 1 and v.read("t").count() == 3 and v.changed_since(0)
    v.restore(0)
    assert v.read("t").count() == 2


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_whole_texts(spark, tmp_path):
    texts = ["one beginning of many words " + "x y" * 90 + " one", "one beginning of many words " + "x y" * 90 + " two", "é" * 2500, "short", "short", "z " * 700]
    rows = [(k, t, "en" if k < 5 else "fr", "s", len(t)) for k, t in enumerate(texts)]
    d = table(spark, tmp_path, "documents", rows, DOCS)
    run = lambda n: catalogue.QUERIES[n](spark, d).collect()
    packs, at = {}, {}
    for _, t, lang, _, _ in rows:
        if lang in at and len(packs[lang, at[lang]]) + 2 + len(t) <= 2000:
            packs[lang, at[lang]] += "\n\n" + t
        else:
            at[lang] = at.get(lang, -1) + 1
            packs[lang, at[lang]] = t
    assert {(r.lang, r.pack): r.text for r in run("text_packing")} == packs
    assert {r.title: r.contents for r in run("section_group")} == {"en0": "\n\n".join(texts[:4]), "fr0": texts[5]}
    assert {r.content for r in run("record_build")} == set(texts)
    assert {r.doc_id: r.contents for r in run("contents_assembly")} == {k: "\n\n".join(["s"] + ["en" if k < 5 else "fr"] * (k % 2) + [" ".join(t.split())]) for k, t in enumerate(texts)}


def test_rows_of_all_languages(spark, tmp_path):
    texts = ["The Éva and a thé, an Öztürk!", "plain of the  text", "中文 of the\nnaïve a", "Straße \x07 and ÉCOLE", "plain of the text"]
    d = table(spark, tmp_path, "documents", [(k, t, ["de", "fr", "zh", "en", "fr"][k], "s é", len(t)) for k, t in enumerate(texts)], DOCS)
    table(spark, tmp_path, "benchmark", [(5 * k, t) for k, t in enumerate(texts)], "item_id long, text string")
    run = lambda n: catalogue.QUERIES[n](spark, d).collect()
    flat = [" ".join(t.split()) for t in texts]
    keys = [" ".join(re.sub(r"\b(a|an|the)\b", " ", "".join(x for x in t.lower() if x not in string.punctuation)).split()) for t in texts]
    got = {r.doc_id: r for r in run("text_normalisers")}
    for k, t in enumerate(texts):
        assert got[k].clean == re.sub(r"[\x00-\x1f\x7f-\x9f]", "", t) and got[k].query_key == flat[k].lower() and got[k].answer_key == keys[k]
        assert got[k].summary == flat[k] and got[k].preview == t and got[k].dataset == "s"
    words = [collections.Counter(k.split()) for k in keys]
    f1 = {(5 * i, 5 * j): round(2 * (x & y).total() / (x.total() + y.total()), 6) for i, x in enumerate(words) for j, y in enumerate(words)}
    assert {(r.a, r.b): r.f1 for r in run("token_f1")} == f1
    assert {(r.page, r.section, r.alias) for r in run("answer_in_section")} == {(0, 0, "and"), (1, 0, "of the"), (2, 0, "of the"), (3, 0, "and"), (4, 0, "of the")}
    assert {(r.content, r.doc_id) for r in run("content_lookup")} == {(flat[k].lower(), k) for k in range(4)}


def test_bins_hold_every_item(spark, tmp_path):
    sizes = [(k * 7919) % 301 for k in range(9000)]
    d = table(spark, tmp_path, "benchmark", [(k, "x" * n) for k, n in enumerate(sizes)], "item_id long, text string")
    got = {r.item_id: (r.bin, r.n) for r in catalogue.QUERIES["greedy_bins"](spark, d).collect()}
    want = {i: (b, sizes[i]) for b, ids in enumerate(P.greedy_partition(sizes, 4)) for i in ids}
    assert got == want
    got = {r.item_id: (r.bin, r.n) for r in catalogue.QUERIES["balanced_bins"](spark, d).collect()}
    assert {i: n for i, (_, n) in got.items()} == dict(enumerate(sizes))
    sums = [sum(n for b, n in got.values() if b == k) for k in range(4)]
    assert max(sums) - min(sums) <= max(sizes)
    for at in range(0, len(sizes), 4096):  # a batch's rows lie together as one task would have them
        batch = sizes[at : at + 4096]
        together = {k: {i for i in range(len(batch)) if got[at + i][0] == k} for k in range(4)}
        assert {frozenset(x) for x in together.values()} == {frozenset(x) for x in P.differencing_partition(batch, 4)}


def test_all_ids(spark, tmp_path):
    customers = [(k, k % 3, "ABC"[k % 3]) for k in range(1, 45)]
    d = table(spark, tmp_path, "customer", customers, "c_custkey long, c_nationkey int, c_mktsegment string")
    table(spark, tmp_path, "supplier", [(k, k) for k in range(6)], "s_suppkey long, s_nationkey int")
    lines = [(o, p, 1.0) for o in range(1, 40) for p in (o % 5, o % 7)]
    table(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_quantity double")
    run = lambda n: catalogue.QUERIES[n](spark, d).collect()
    edges = {(f"o{o}", f"p{p}") for o, p, _ in lines}
    both = edges | {(b, a) for a, b in edges}
    walks = {(r.start, r.step): r.node for r in run("random_walks")}
    assert set(walks) == {(a, k) for a, _ in both for k in range(4)}
    assert all(walks[a, 0] == a and all((walks[a, k], walks[a, k + 1]) in both for k in range(3)) for a, _ in both)
    pairs = {(c, s, "url") for c, n, _ in customers for s in range(6) if 2 * n == s}
    pairs |= {(c, s, "title") for c, n, _ in customers for s in range(6) if 2 * n > 5 and c % 7 == s % 5}
    assert {(r.c_custkey, r.b_s_suppkey, r.match_key) for r in run("fallback_key_join")} == pairs
    assert {(r.dimension, r.value): r.n for r in run("alignment_summary")} == {("match_key", "url"): 44} | {("c_mktsegment", x): sum(c[2] == x for c in customers) for x in "ABC"}
    wide = [(k, 0, "A") for k in range(1, 46)] + [(11 * k + 7, 0, "A") for k in range(10, 20)]  # the key 7 has most customers
    (tmp_path / "wide").mkdir()
    d = table(spark, tmp_path / "wide", "customer", wide, "c_custkey long, c_nationkey int, c_mktsegment string")
    assert {(r.source, r.target) for r in run("connected_component_largest")} == {(f"C{k}", "K7") for k, _, _ in wide if k % 11 == 7}
    assert {r.query for r in run("match_fallback")} == set(range(10))


def test_text_units_count_once_for_each_node(spark):
    from hyperweave.plans import retrieval as R

    lines = [(f"h{(i * 7) % 23}", f"e{i % 5}", f"c{i % 9}") for i in range(120)]
    edges = spark.createDataFrame(sorted({(h, e, 1.0) for h, e, _ in lines}), "hyperedge string, entity string, weight double")
    src = {(n, c) for h, e, c in lines for n in (h, e)}
    tokens = {f"c{i}": 10 + i for i in range(8)}  # c8 has no text
    seeds = [(q, pos, f"e{(q + pos) % 6}") for q in range(12) for pos in range(3)]
    got = R.text_units_from_entities(edges, spark.createDataFrame(sorted(src), "node string, chunk string"), spark.createDataFrame(seeds, "query int, pos int, node string"), spark.createDataFrame(list(tokens.items()), "chunk string, tokens int"), 60)
    assert not re.search(r"Aggregate \[query#\d+L?, node", got._jdf.queryExecution().optimizedPlan().toString())  # else hop rows grow with the queries
    near, want = {(h, e) for h, e, _ in lines}, set()
    for q in range(12):
        units = {}
        for _, pos, n in (s for s in seeds if s[0] == q):
            for c in {c for m, c in src if m == n and c in tokens}:
                k = sum((h, c) in src for h, e in near if e == n)
                p, r = units.get(c, (pos, k))
                units[c] = (min(p, pos), max(r, k))
        total = 0
        for c, (p, r) in sorted(units.items(), key=lambda x: (x[1][0], -x[1][1], x[0])):
            total += tokens[c]
            if total > 60:
                break
            want.add((q, c, p, r, tokens[c]))
    assert {(r.query, r.chunk, r.pos, r.relations, r.tokens) for r in got.collect()} == want


def test_first_file_wins_by_place_in_the_table(spark, tmp_path):
    """Rows of one order: the first in the table wins, though later files are larger and are read first."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(6):
        n = 20 * (k + 1) ** 3
        pq.write_table(pa.table({"l_partkey": [i % 20 for i in range(n)], "l_suppkey": [1_000_000 * k + i for i in range(n)], "l_orderkey": [3] * n, "l_linenumber": [1] * n}), tmp_path / f"lineitem.parquet/part-{k}.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["first_file_wins"](spark, str(tmp_path)).collect()}
    assert got == {(i, i, 31) for i in range(20)}


def test_first_file_wins_takes_rows_without_an_order_last(spark, tmp_path):
    """A null order key had come first; the SQL takes it last, and only where a part has no other."""
    import duckdb

    lines = [(1, 10, None, 1), (1, 11, 5, 2), (1, 12, 5, None), (1, 13, 4, 9), (2, 20, None, 3), (None, 30, 7, None), (None, 31, 8, 1)]
    d = table(spark, tmp_path, "lineitem", lines, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int")
    got = {tuple(r) for r in catalogue.QUERIES["first_file_wins"](spark, d).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{d}/lineitem.parquet/*.parquet')")
    assert got == set(con.execute(catalogue.ORACLE_SQL["first_file_wins"]).fetchall()) == {(1, 13, 49), (2, 20, None), (None, 31, 81)}


def test_order_graph_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    """Grouping had begun in the input's splits, whose tasks grew with the table (statistics threefold, by three counts)."""
    from hyperweave import session
    from hyperweave.operators import graph as G
    from hyperweave.plans.base import orders_graph
    from hyperweave.plans.retrieval_queries import _sources

    monkeypatch.setattr(session, "ROWS", 10)
    lines = [(o, p, p, 1.0) for o in range(40) for p in (o % 5, o % 7)] + [(1, None, 2, 1.0)]
    d = table(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")
    table(spark, tmp_path, "supplier", [(k,) for k in range(7)], "s_suppkey long")
    g = orders_graph(spark, d)
    assert g.rdd.getNumPartitions() == 9 and _sources(spark, d)[0].rdd.getNumPartitions() == 17
    assert "Expand" not in G.statistics(g)._jdf.queryExecution().toString()
    edges = {(f"o{o}", f"p{p}") for o, p, *_ in lines if p is not None}
    assert G.statistics(g).first().asDict() == {"hyperedges": 40, "entities": 7, "edges": len(edges), "nodes": 47}
    back = {(r.kind, r.a, r.b) for r in catalogue.QUERIES["node_link_json"](spark, table(spark, tmp_path / "whole", "lineitem", lines[:-1], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")).collect()}
    assert back == {("edge", *e) for e in edges} | {("node", x, None) for e in edges for x in e}


def test_records_are_not_dealt_before_they_are_merged(spark):
    """Texts had been sorted twice to be made distinct, and every record dealt and sorted to find its hyper-relation."""
    from hyperweave.plans import construction as C

    texts = ["Alpha met Betatron. Gamma left &amp; Delta.", "one Alpha", " Alpha met Betatron. Gamma left &amp; Delta. ", "", "Alpha met Betatron. " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = C.insert_documents(docs, "text")
    found = made["incidence"].drop("sources")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "Sort " not in plan and "Window" not in plan
    cuts = {" ".join(w[k : k + 768]) for t in texts for w in [t.split()] for k in range(0, len(w), 704)}
    want = collections.Counter((f"<hyperedge>{x.strip().replace('&amp;', '&')}", e.upper()) for c in cuts for x in re.split(r"[.!?]\s+", c) for e in dict.fromkeys(re.findall("[A-Z][a-z]+|[A-Za-z]{9,}", x)))
    assert {(r.hyperedge, r.entity): r.weight for r in found.collect()} == dict(want) and len(cuts) == 4 and max(want.values()) > 400
    assert made["full_docs"].count() == 3 and made["chunks"].count() == len({s for r in made["incidence"].collect() for s in r.sources})
    again = C.insert_documents(docs, "text", known_docs=made["full_docs"].limit(3), known_chunks=made["chunks"])
    assert again["incidence"].count() == again["full_docs"].count() == 0
    odd = '("entity"<|>"x"<|>"t"<|>"d"<|>1)##("hyper-relation"<|>"A"<|>2)##junk##("entity"<|>"y"<|>"t"<|>"d"<|>3)##("hyper-relation"<|>"B"<|>4)##("entity"<|>" "<|>"t"<|>"d"<|>5)'
    odd = C.parse_records(spark.createDataFrame([("c", odd)], "chunk string, response string"))
    assert [(r.pos, r.kind, r.name, r.weight, r.hyperedge) for r in odd.orderBy("pos").collect()] == [(1, "hyperedge", '<hyperedge>"A"', 2.0, '<hyperedge>"A"'), (3, "entity", '"Y"', 3.0, '<hyperedge>"A"'), (4, "hyperedge", '<hyperedge>"B"', 4.0, '<hyperedge>"B"'), (5, "entity", '" "', 5.0, '<hyperedge>"B"')]
