"""Bootstrap metrics, the reward manager and balanced bins against plain Python."""

import hashlib
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from hyperweave.functions import scores as S
from hyperweave.operators import advantages as A
from hyperweave.operators import merges
from hyperweave.operators import partition as P
from hyperweave.operators.rewards import reward_manager


def test_bootstrap_metrics(spark):
    rng = random.Random(1)
    rows = [(f"s{p % 2}", f"p{p}", i, rng.choice([0.0, 0.5, 1.0]), rng.choice("abc")) for p in range(6) for i in range(rng.randint(1, 6))] + [("s0", "p0", 99, None, "a")]
    df = spark.createDataFrame(rows, "source string, problem string, i int, score double, answer string")
    got = {(r.source, r.metric, r.size): (r.mean, r.std) for r in A.bootstrap_metrics(df, "source", "problem", "i", "score", "answer", sizes=[2, 3], draws=50, seed=7).collect()}
    want = {}
    for s, p in sorted({(r[0], r[1]) for r in rows}):
        x = sorted((i, v, a) for s_, p_, i, v, a in rows if (s_, p_) == (s, p) and v is not None)
        values = [v for _, v, _ in x]
        want.setdefault((s, "mean", len(x)), []).append((statistics.fmean(values), statistics.pstdev(values)))
        for k in (2, 3):
            found = {"best": [], "worst": [], "maj": []}
            for b in range(50):
                y = [x[int(hashlib.md5(f"7:{p}:{k}:{b}:{j}".encode()).hexdigest()[:8], 16) % len(x)] for j in range(k)]
                found["best"].append(max(v for _, v, _ in y))
                found["worst"].append(min(v for _, v, _ in y))
                answers = [a for *_, a in y]
                most = max(answers, key=lambda a: (answers.count(a), -answers.index(a)))
                found["maj"].append(y[answers.index(most)][1])
            for m, v in found.items():
                want.setdefault((s, m, k), []).append((statistics.fmean(v), statistics.pstdev(v)))
    assert got.keys() == want.keys()
    for key, parts in want.items():
        assert got[key] == pytest.approx(tuple(statistics.fmean(x) for x in zip(*parts)))


def test_bootstrap_sources_share_the_draws_of_a_problem(spark):
    """Each of them had drawn all samples again, and asked each of its attempts for votes one by one: minutes for this table."""
    rows = [(None if s == 3 else s, None if p == 2 else p, i, (s + i) % 4 / 3.0, None if i % 2 else "a") for s in range(600) for p in range(3) for i in range(5)]
    df = spark.createDataFrame(rows, "source int, problem int, i int, score double, answer string")
    run = lambda d: {(r.source, r.metric, r.size): (r.mean, r.std) for r in A.bootstrap_metrics(d, "source", "problem", "i", "score", "answer").where("metric <> 'mean'").collect()}
    began = time.time()
    got = run(df)
    assert time.time() - began < 40
    assert got.keys() == {(None if s == 3 else s, m, k) for s in range(600) for m in ("best", "worst", "maj") for k in (2, 4, 8)}
    for key, found in run(df.where("source = 5")).items():
        assert got[key] == pytest.approx(found)


def test_reward_manager(spark):
    rows = [(1, "em", "The Cat", ["cat"], [1, 1, 0], None), (2, "em", "dog", ["cat"], [1, 1, 1], None), (3, "f1", "a cat sat", ["cat"], [0, 0, 0], None), (4, "em", None, None, [1], None), (5, "em", "x", ["y"], [1, 0], 0.25)]
    df = spark.createDataFrame(rows, "id int, source string, response string, golds array<string>, mask array<int>, known double")
    got = {r.id: (round(r.score, 4), [round(x, 4) for x in r.reward]) for r in reward_manager(df, {"em": S.exact_match, "f1": S.token_f1}, "source", "response", "golds", "mask", rest="known").collect()}
    assert got == {1: (1.0, [0, 1.0, 0]), 2: (0.0, [0, 0, 0.0]), 3: (0.6667, [0, 0, 0.6667]), 4: (0.0, [0.0]), 5: (0.25, [0.25, 0])}
    with pytest.raises(Exception, match="no scorer for the data source em"):
        reward_manager(df, {"f1": S.token_f1}, "source", "response", "golds", "mask").collect()


def test_f1_of_counts(spark):
    texts = ["the cat sat on the cat", "Cat, cat!", "", None, "a an the", "dog"]
    df = spark.createDataFrame([(x, y) for x in texts for y in texts if x is not None and y is not None], "x string, y string")
    for r in df.select("x", "y", S.f1_of_counts(S.answer_counts("x"), S.answer_counts("y")).alias("n"), S.token_f1("x", F.array("y")).alias("f")).collect():
        assert r.n == pytest.approx(r.f), (r.x, r.y)


@pytest.mark.parametrize("n,k,batch", [(0, 3, 4), (2, 3, 4), (100, 3, 7), (61, 4, 5), (50, 2, 4096)])
def test_balanced_bins_over_batches(spark, n, k, batch):
    rng = random.Random(n)
    rows = [(i, rng.randint(0, 100)) for i in range(n)]
    got = P.balanced_bins(spark.createDataFrame(rows, "id long, n int"), "id", "n", k, batch).collect()
    assert sorted((r.id, r.n) for r in got) == rows and {r.bin for r in got} <= set(range(k))
    sums = [sum(r.n for r in got if r.bin == b) for b in range(k)]
    assert max(sums) - min(sums) <= max((x for _, x in rows), default=0)
    if batch > n:  # one task's answer
        one = P.differencing_partition([float(x) for _, x in rows], k)
        assert sorted(sorted(r.id for r in got if r.bin == b) for b in range(k)) == sorted(one)


def test_micro_batches(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(25)], "id long, n int")
    sums = P.micro_batched(rows, "id", "n", 100).groupBy("bin").agg(F.sum("n").alias("s")).collect()
    assert len(sums) == 3 and max(r.s for r in sums) <= 100


@pytest.mark.parametrize("n,k", [(1000, 65), (90, 100), (20_000, 5_000)])
def test_many_bins_are_dealt(spark, n, k):
    """As many bins as this were differenced for minutes: every step touched all of them."""
    rng = random.Random(k)
    rows = [(i, None if i == 7 else rng.randint(1, 1000)) for i in range(n)]
    began = time.time()
    got = P.balanced_bins(spark.createDataFrame(rows, "id long, n int").repartition(5), "id", "n", k).collect()
    assert time.time() - began < 60
    assert sorted((r.id, r.n) for r in got) == sorted(rows) and {r.bin for r in got} == set(range(min(n, k)))
    sums = [0] * k
    for r in got:
        sums[r.bin] += r.n or 0
    assert max(sums) - min(sums) <= 1000


def test_packs_count_the_joint_of_an_empty_first_text(spark):
    rows = [("g", 1, ""), ("g", 2, "abcd"), ("g", 3, "ef"), ("h", 1, None), ("h", 2, "abcdefgh")]
    got = {(r.g, r.pack): r.text for r in merges.pack(spark.createDataFrame(rows, "g string, i int, t string"), "g", "i", "t", 8).collect()}
    assert got == {("g", 0): "\n\nabcd", ("g", 1): "ef", ("h", 0): "", ("h", 1): "abcdefgh"}
