"""Hard negatives and near-duplicate vectors against all pairs by brute force."""

import collections
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyperweave.llm import centroids, multiindex, negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rep string, list int, score double, width int, id string, v string, cell int, links int, number int"


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, 0.5, 2, "y", "z", 3, 4, 5) for i, label, v in rows], SCHEMA)


def plain(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


NAN, INF = float("nan"), float("inf")
ODD = [(9001, 1, None), (9002, 1, [0.0] * 6), (9003, 1, [1.0, None] * 3), (9004, 1, [NAN] * 6), (9005, 1, [INF] * 6), (9006, None, [0.1] * 6), (None, 1, [0.1] * 6), (9007, 1, []), (9050, 1, []), (9008, 2, []), (9009, 1, [0.3]), (9100, 1, [0.4]), (9010, 2, [0.3])]


def clustered(seed, n, d, labels=3, hot=0, far=0.05):
    """Near copies of some vectors, one group of them large, exact copies and repeated rows."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(1, n // 6), d))
    out = []
    for i in range(n):
        of = 0 if i < hot else rng.integers(len(base))
        v = base[of] + rng.normal(size=d) * rng.choice([0, far, 3 * far, 6 * far]) * 1.0
        out.append((int(i), int(of % labels), v.astype(np.float32).tolist()))
    return out + out[:3]


# 11


def brute_negatives(rows, k=5, m=3):
    use = [(i, label, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, label, v in rows if i is not None and label is not None and plain(v)]
    out, seen = collections.Counter(), set()
    for i, label, v in use:
        if i % 50 or (i, label, tuple(v)) in seen:
            continue
        seen.add((i, label, tuple(v)))
        scored = [(int(w @ v), j, other) for j, other, w in use if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, j, _ in [x for x in scored if x[2] == label][:k]:
            fit = [x for x in scored if x[2] != label and 50 * p <= 100 * x[0] <= 95 * p][:m]
            out.update((i, j, r, x[1], p, x[0]) for r, x in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("seed,most", [(0, negatives.SLICE), (1, 3)])
def test_hard_negatives(spark, odd, seed, most):
    rows = clustered(seed, 500, 6, hot=150) + ODD
    got = negatives.mine(table(spark, rows), F.col("id") % 50 == 0, most=most)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows)
    assert collections.Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_of_nothing(spark, odd):
    assert negatives.mine(table(spark, []), F.col("id") % 50 == 0).count() == 0
    assert negatives.mine(table(spark, [(1, 1, [0.5])]), F.col("id") % 50 == 0).count() == 0


def test_large_and_small_components(spark, odd):
    rng = np.random.default_rng(3)
    rows = [(k, int(k % 2), (rng.normal(size=4) * 10.0 ** int(rng.integers(0, 7))).astype(np.float32).tolist()) for k in range(120)]
    got = negatives.mine(table(spark, [*rows, (600, 1, [1e30] * 4)]), F.col("id") % 50 == 0)
    assert collections.Counter(map(tuple, got.collect())) == brute_negatives(rows)


def test_lists_are_skipped_by_their_bounds(monkeypatch):
    """All answers come, though most lists are never visited."""
    monkeypatch.setattr(negatives, "LIST", 20)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 8)) * 4000
    v = (middles[np.arange(2000) % 40] + rng.normal(size=(2000, 8)) * 30).astype(np.int64)
    ids, labels = np.arange(2000), np.arange(2000) // 40 % 3
    books = {8: centroids.k_means(v[::7].astype(float), 40)}
    near, apart = negatives._nearest(books, 8, v)
    order = np.lexsort((apart, near))
    columns = {"width": np.full(2000, 8), "list": near[order], "apart": apart[order], "id": ids[order], "label": labels[order]}
    group = pa.table({**columns, "v": pa.array(v[order].tolist(), pa.list_(pa.int64()))})
    asked = negatives.Anchors(np.arange(20), ids[:20], labels[:20], v[:20], 5)
    asked.seed(ids[::7], labels[::7], v[::7])
    visits = []
    kept = asked.meet
    asked.meet = lambda best, at, *more: (visits.append(len(at)), kept(best, at, *more))
    best = asked.begin()
    lists = negatives._lists(group, books)[8]
    asked.visit(best, lists)
    scores = v[:20] @ v.T
    for k in range(20):
        want = [j for j in np.lexsort((ids, -scores[k])) if j != k and labels[j] == labels[k]][:5]
        assert best[0].ids[k].tolist() == want
    assert sum(visits) < 20 * len(lists) / 3


def test_best_keeps_ties_by_id():
    best = negatives.Best(np.array([negatives.NONE, 5]), 2)
    best.meet(np.array([0, 1]), np.array([[5, 5, 5], [5, 4, 5]]), np.array([3, 7, 9]), np.ones((2, 3), bool))
    best.meet(np.array([0]), np.array([[5, 6]]), np.array([1, 8]), np.array([[True, False]]))
    assert best.ids.tolist() == [[1, 3], [3, 9]] and best.scores.tolist() == [[5, 5], [5, 5]]


# 12


def brute_links(rows, threshold=0.98):
    use = [k for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and plain(v) and any(v)]
    n, low = [0] * len(rows), [r[0] for r in rows]
    near = collections.defaultdict(list)
    for a in use:
        for b in use:
            if a < b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if (x * y).sum() / (math.sqrt((x * x).sum()) * math.sqrt((y * y).sum())) >= threshold:
                    near[a].append(b)
                    near[b].append(a)
    for a in use:
        seen, stack = {a}, [a]
        while stack:
            for b in near[stack.pop()]:
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        n[a], low[a] = len(near[a]), min(rows[k][0] for k in seen)
    return collections.Counter((r[0], n[k], low[k], r[0] is None or r[0] == low[k]) for k, r in enumerate(rows))


@pytest.mark.parametrize("seed,n,d,cell,codes", [(0, 300, 8, 1024, 6), (1, 260, 5, 7, 4), (2, 240, 2, 1024, 9), (3, 200, 1, 3, 2), (4, 300, 16, 20, None)])
def test_near_duplicates(spark, odd, monkeypatch, seed, n, d, cell, codes):
    monkeypatch.setattr(multiindex, "CELL", cell)
    monkeypatch.setattr(multiindex, "VISITS", 2 * cell)
    rows = clustered(seed, n, d, hot=n // 3, far=0.04) + ODD
    got = multiindex.near_duplicates(table(spark, rows), codes=codes)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(map(tuple, got.collect())) == brute_links(rows)


def test_near_duplicates_of_nothing(spark, odd):
    assert multiindex.near_duplicates(table(spark, [])).count() == 0
    got = multiindex.near_duplicates(table(spark, [(3, None, [1.0]), (4, 1, None)])).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_chains_and_lengths_near_the_ends_of_doubles(spark, odd):
    turn = lambda k, size: [size * math.cos(0.15 * k), size * math.sin(0.15 * k)]
    rows = [(100 - k, 1, turn(k, 10.0 ** (30 if k % 2 else -30))) for k in range(40)]
    got = multiindex.near_duplicates(table(spark, rows), codes=5)
    assert collections.Counter(map(tuple, got.collect())) == brute_links(rows)


@pytest.mark.parametrize("d,codes", [(2, 12), (7, 10), (32, 12)])
def test_one_of_two_that_link_visits_the_other(d, codes):
    """The bound that stops the traversal, at the threshold itself and across many borders."""
    rng = np.random.default_rng(d)
    u = rng.normal(size=(4000, d))
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    side = rng.normal(size=u.shape)
    side -= (side * u).sum(1, keepdims=True) * u
    side /= np.sqrt((side * side).sum(1, keepdims=True))
    v = 0.98 * u + math.sqrt(1 - 0.98**2) * side
    grid = multiindex.Grid(u[:500], codes)
    limit = multiindex.reach(0.98, d, 1.0)
    (a, visits_a), (b, visits_b) = grid.cells(u, limit), grid.cells(v, limit)
    met = [y in x or z in w for y, x, z, w in zip(b, visits_a, a, visits_b)]
    assert all(met) and (a != b).mean() > 0.3
    assert all(x[0] == h for x, h in zip(visits_a, a)) and max(map(len, visits_a)) <= codes * codes
    if d == 32:
        some = multiindex.reach(0.98, d, 0.9)
        (_, visits_a), (_, visits_b) = grid.cells(u, some), grid.cells(v, some)
        share = np.mean([y in x or z in w for y, x, z, w in zip(b, visits_a, a, visits_b)])
        assert some < limit and 0.9 <= share < 1
