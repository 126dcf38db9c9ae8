"""The shard cover against all subsets, and its time on many shards."""

import random
import time
from itertools import combinations

from hyperweave.operators.partition import shard_cover


def brute(shards, wanted):
    best = None
    for n in range(len(shards) + 1):
        for pick in combinations(sorted(shards), n):
            if wanted <= set().union(set(), *(s[2] for s in pick)):
                cost = (sum(s[1] for s in pick), n, sorted(s[0] for s in pick))
                best = cost if best is None or cost < best else best
    return best[2] if best else []


def instance(rng, shards, items, sizes):
    return [(f"s{k:02}", rng.choice(sizes), {rng.randrange(items) for _ in range(rng.randint(0, 6))}) for k in range(shards)], set(range(items))


def test_same_choice_as_all_subsets():
    rng = random.Random(0)
    for _ in range(60):
        shards, wanted = instance(rng, rng.randint(1, 11), rng.randint(1, 9), [1, 2, 3, 5] if rng.random() < 0.7 else [0, 1])
        rng.shuffle(shards)
        assert shard_cover(shards, wanted) == brute(shards, wanted)
    assert shard_cover([("a", 1, {1})], set()) == [] and shard_cover([], {1}) == []


def test_many_shards():
    for seed in range(3):
        shards, wanted = instance(random.Random(seed), 60, 40, range(50, 500))
        shards += [(f"t{k}", 600, {k}) for k in wanted]
        start = time.time()
        assert shard_cover(shards, wanted)
        assert time.time() - start < 20
