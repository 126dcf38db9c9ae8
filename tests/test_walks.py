"""Second-order walks: every step an edge, and the shares of steps as the weights have them."""

import collections

import pytest

from hyperweave.operators import graph as G

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (4.0, 0.5), (0.25, 2.0)])
def test_shares_of_steps(spark, p, q):
    df = spark.createDataFrame([(a, b, 1.0) for a, b in EDGES], "hyperedge string, entity string, weight double")
    near = collections.defaultdict(set)
    for a, b in EDGES:
        near[a].add(b)
        near[b].add(a)
    n = 3000
    paths = collections.defaultdict(dict)
    for r in G.biased_walks(df, 2, p, q, seed=5, walks=n).collect():
        paths[r.start, r.walk][r.step] = r.node
    assert len(paths) == 5 * n and all(x[0] == start and set(x) == {0, 1, 2} for (start, _), x in paths.items())
    met = collections.defaultdict(collections.Counter)
    for x in paths.values():
        assert x[1] in near[x[0]] and x[2] in near[x[1]]
        met[x[0], x[1]][x[2]] += 1
    for (t, v), seen in met.items():
        weight = {x: 1 / p if x == t else 1.0 if x in near[t] else 1 / q for x in near[v]}
        total, every = sum(weight.values()), sum(seen.values())
        for x, w in weight.items():
            want = w / total
            assert abs(seen[x] / every - want) < 4.5 * (want * (1 - want) / every) ** 0.5 + 1e-9, (t, v, x)


def test_embeddings_of_walks(spark):
    df = spark.createDataFrame([(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(6) for j in range(i)], "hyperedge string, entity string, weight double")
    walks = G.biased_walks(df, 6, walks=8)
    assert {r.node for r in walks.collect()} == {f"{g}{i}" for g in "xy" for i in range(6)}
    got = {r.node: r.embedding for r in G.node_embeddings(walks, size=8, rounds=3).collect()}
    assert len(got) == 12 and all(len(v) == 8 for v in got.values())


def test_walkers_at_leaves_go_back_at_once(spark, monkeypatch):
    """A walker at a leaf can only go back, however little that weighs: it takes one round, not one for each rejection."""
    rounds = []
    monkeypatch.setattr(G, "settled", lambda df, f=G.settled: rounds.append(1) or f(df))
    df = spark.createDataFrame([(f"h{i}", "hub", 1.0) for i in range(300)], "hyperedge string, entity string, weight double")
    got = G.biased_walks(df, 3, p=1000.0, q=0.5).collect()
    assert len(got) == 4 * 301 and len(rounds) == 4
    assert {r.node for r in got if r.start != "hub" and r.step in (1, 3)} == {"hub"}


@pytest.mark.parametrize("most", [2, 1024])
def test_hyperedges_and_entities_apart_take_one_join_a_step(spark, monkeypatch, most):
    """Edges had been dealt three times for each step, and draws rejected, though no two neighbours of a node can be linked."""
    import hashlib
    import re

    plans = []
    monkeypatch.setattr(G, "LIST", most, raising=False)
    monkeypatch.setattr(G, "settled", lambda df, f=G.settled: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df))
    edges = {(f"h{i}", f"e{j}") for i in range(9) for j in range(7) if (i * j) % 3 == 1 or j == 0} | {("h1", None), ("h9", None), (None, "e8")}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges, key=str)] * 2, "hyperedge string, entity string, weight double")
    got = sorted(map(tuple, G.biased_walks(df, 4, p=4.0, q=2.0, walks=5).collect()), key=str)
    assert len(plans) == 5
    if most > 9:
        assert all(len(re.findall(r"\bJoin ", x)) <= 1 for x in plans)
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    there = {v: sorted(x, key=lambda y: (y is not None, y)) for v, x in near.items() if v is not None}  # nulls first
    drawn = lambda *x: int(hashlib.md5(":".join(map(str, x)).encode()).hexdigest()[:8], 16)
    want = []
    for start in there:
        for w in range(5):
            before, node = None, start
            for k in range(5):
                if k:
                    n, other = there[node], drawn(42, start, w, f"{k}:0")
                    if k == 1:
                        i = other % len(n)
                    else:
                        back, i = n.index(before), other % max(len(n) - 1, 1)
                        share = (1 / 4) / (1 / 4 + (len(n) - 1) / 2)
                        i = back if drawn(42, start, w, f"{k}:0", "back") < share * 2**32 else i + (i >= back)
                    before, node = node, n[i]
                want.append((start, w, k, node))
                if node is None:
                    break
    assert got == sorted(want, key=str) and any(r[3] is None for r in got)


def test_walks_do_not_depend_on_the_length_of_lists(spark, monkeypatch):
    """With nodes that are hyperedges and entities, loops and hubs."""
    edges = sorted({(f"n{i}", f"n{(i * i + j) % 30}", 1.0) for i in range(30) for j in range(4)} | {("n0", f"n{j}", 1.0) for j in range(30)})
    df = spark.createDataFrame(edges, "hyperedge string, entity string, weight double")
    whole = sorted(map(tuple, G.biased_walks(df, 3, p=0.5, q=4.0, walks=3).collect()))
    monkeypatch.setattr(G, "LIST", 5)
    assert sorted(map(tuple, G.biased_walks(df, 3, p=0.5, q=4.0, walks=3).collect())) == whole and len(whole) == 30 * 3 * 4
    assert G.biased_walks(df.limit(0), 3).collect() == []
    monkeypatch.setattr("hyperweave.session.ROWS", 10)
    assert G._lists(df, of=df).rdd.getNumPartitions() == -(-len(edges) // 10)


def test_a_walker_takes_each_step_once(spark):
    """Every step had been made anew for each longer one: six pairs of joins for three steps. Nulls end a walk."""
    import hashlib

    edges = {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", None), (None, "e")}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(edges, key=str)] * 2, "hyperedge string, entity string, weight double")
    walks = G.random_walks(df, 3)
    plan = walks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 4 and "Union" not in plan
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = set()
    for start in near:
        node = start
        want.add((start, 0, node))
        for k in (1, 2, 3):
            if node is None:
                break
            there = sorted(near[node], key=lambda x: (x is not None, x))  # Spark's order: nulls first
            node = there[int(hashlib.md5(f"{42 + k}:{start}".encode()).hexdigest()[:8], 16) % len(there)]
            want.add((start, k, node))
    assert {tuple(r) for r in walks.collect()} == want and (None, 0, None) in want and any(k and n is None for _, k, n in want)
    assert G.random_walks(df, 3).count() == len(want)
    assert {tuple(r) for r in G.random_walks(df, 0).collect()} == {x for x in want if x[1] == 0}
