"""Balanced partitions of lengths, seeded samples and orders."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


def numbered(df: DataFrame, *order: Column | str, into: str = "place") -> DataFrame:
    """df with the rows' places in the order, from 0, without gathering them in one task: rows are sorted by range, each
    range numbers its own, and the ranges' sizes, summed up, shift them. The sorted table is settled."""
    m = F.col("__m")
    rows = settled(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, own = F.shiftright(m, 33), m.bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + own).drop("__part", "__before", "__m")


def running_total(df: DataFrame, value: str, *order: Column | str, into: str = "total") -> DataFrame:
    """df with the sum of the values up to each row, by the same two steps."""
    m = F.col("__m")
    rows = settled(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id())).withColumn("__part", F.shiftright(m, 33))
    sums = rows.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy("__m").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(into, F.col("__before") + F.col("__own")).drop("__part", "__before", "__own", "__m")


def seeded(seed: int, *columns: str) -> Column:
    """A deterministic order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample(df: DataFrame, n: int, key: str, seed: int = 42, restore: str | None = None) -> DataFrame:
    """The n rows that come first in the seeded order, in that order, or in the order of `restore`."""
    order = seeded(seed, key)
    out = df.withColumn("__o", order).orderBy("__o", key).limit(n)
    return (out.orderBy(restore) if restore else out.orderBy("__o", key)).drop("__o")


def bounded_samples(df: DataFrame, group: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of every group, with the group's count."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    counts = df.groupBy(*group).agg(F.count("*").alias("total"))
    return df.withColumn("place", rank).where(F.col("place") <= n).join(counts, group)


def round_robin(df: DataFrame, key: str, shard: str, row: str, seed: int = 42) -> DataFrame:
    """A stratified order: seeded within (key, shard); shards of a key take turns, then keys take turns. Column `place`."""
    order = seeded(seed, row)
    turn = F.row_number().over(Window.partitionBy(key, shard).orderBy(order, row))
    df = df.withColumn("__t", turn)
    in_key = F.row_number().over(Window.partitionBy(key).orderBy("__t", shard))
    df = df.withColumn("__k", in_key)
    return numbered(df, "__k", key).withColumn("place", F.col("place") + 1).drop("__t", "__k")


def size_guard(df: DataFrame, size: str, most: int, n: int, order: str) -> DataFrame:
    return df.where(F.col(size) <= most).orderBy(order).limit(n)


def running_budget(df: DataFrame, size: str, order: str, most: int) -> DataFrame:
    """Rows in order as long as their sizes add up to at most `most`."""
    return running_total(df, size, order, into="__total").where(F.col("__total") <= most).drop("__total")


def repeated(df: DataFrame, n: int, interleave: bool = True, pos: str = "pos") -> DataFrame:
    """Every row n times: each one's copies together, or the whole table again and again. Column `place` orders them."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = (pos, "copy") if interleave else ("copy", pos)
    return numbered(out, *keys)


def padded_to(df: DataFrame, divisor: int, pos: str) -> DataFrame:
    """The first rows again at the end, flagged, until the count divides."""
    missing = -df.count() % divisor
    return df.withColumn("is_pad", F.lit(False)).unionByName(df.orderBy(pos).limit(missing).withColumn("is_pad", F.lit(True)))


def mini_batches(df: DataFrame, size: int, epoch: int, key: str, seed: int = 42) -> DataFrame:
    return numbered(df, seeded(seed + epoch, key), key, into="__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__place")


def inverse_permutation(df: DataFrame, pos: str, target: str) -> DataFrame:
    return df.select(F.col(target).alias(pos), F.col(pos).alias(target))


def greedy_partition(lengths: list[float], k: int) -> list[list[int]]:
    """Each item, in the given order, to the lightest bin (the first of equal ones)."""
    heap, bins = [(0.0, b) for b in range(k)], [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, b = heapq.heappop(heap)
        bins[b].append(i)
        heapq.heappush(heap, (total + n, b))
    return bins


def differencing_partition(lengths: list[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: partial partitions with the widest spread are merged, heaviest bins against lightest."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal_size:
        if len(lengths) % k:
            raise ValueError("items must divide evenly")
        starts = [order[i : i + k] for i in range(0, len(order), k)]
        states = [[(lengths[i], [i]) for i in g] for g in starts]
    else:
        states = [[(lengths[i], [i])] + [(0.0, [])] * (k - 1) for i in order]
    heap = []
    for n, s in enumerate(states):
        s = sorted(s, key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (-(s[0][0] - s[-1][0]), n, s))
    n = len(states)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: (-x[0], x[1]))
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), n, merged))
        n += 1
    return sorted(sorted(ids) for _, ids in heap[0][2]) if heap else [[] for _ in range(k)]


#: Rows, or partial partitions, that one task balances.
BATCH = 4096
#: Bins that differencing fills; each of its steps touches every bin, so more of them are dealt.
DIFFERENCED = 64


def _differenced(states: list[list[float]]) -> tuple[list[float], list[list[int]]]:
    """Largest differencing of partial partitions (each k totals): the totals of the whole, heaviest first, and for every
    state where each of its bins went. Heaviest bins meet lightest, so the whole's spread is no wider than the widest state's."""
    heap, n = [], len(states)
    for i, totals in enumerate(states):
        order = sorted(range(len(totals)), key=lambda j: (-totals[j], j))
        heap.append((-(totals[order[0]] - totals[order[-1]]), i, [(totals[j], [(i, j)]) for j in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), key=lambda x: (-x[0], x[1][0]))
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), n, merged))
        n += 1
    into = [[0] * len(s) for s in states]
    for b, (_, held) in enumerate(heap[0][2]):
        for i, j in held:
            into[i][j] = b
    return [x[0] for x in heap[0][2]], into


def dealt_bins(df: DataFrame, key: str, length: str, k: int) -> DataFrame:
    """(key, bin, length) for all rows: from the longest on, k rows a round, one for each bin, every other round backwards.

    Bins differ in a round by no more than its longest row less its shortest, and the next round begins no higher than
    that, so over all rounds by no more than the longest row. A row costs the same however many bins there are."""
    rows = numbered(df.select(key, length), F.desc_nulls_last(length), key)
    at = F.col("place") % k
    return rows.select(key, F.when(F.floor(F.col("place") / k) % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("bin"), length)


def balanced_bins(df: DataFrame, key: str, length: str, k: int, batch: int = BATCH) -> DataFrame:
    """(key, bin, length) for all rows, by largest differencing of partial partitions; beyond DIFFERENCED bins, dealt.

    Batches of consecutive rows by the key are each balanced in a task of their own; what they come to, k totals for each,
    are partial partitions that are differenced again, a batch of them at a time, until one is left. A row's bin is
    followed through these rounds. The spread of the whole is no wider than that of the worst batch, thus never more
    than the longest row, however many batches there are; rows of one batch get what one task would give them."""
    if k > DIFFERENCED:
        return dealt_bins(df, key, length, k)
    keep = [key, length]
    rows = numbered(df.select(*keep), key, length).withColumn("node", F.floor(F.col("place") / batch))

    def placed(frame):
        frame = frame.sort_values("place", ignore_index=True)
        bins = {i: b for b, ids in enumerate(differencing_partition([float(n) for n in frame[length]], k)) for i in ids}
        return frame[[*keep, "node"]].assign(bin=[bins[i] for i in range(len(frame))])

    def lifted(frame):
        frame = frame.sort_values(["node", "bin"], ignore_index=True)
        nodes = list(dict.fromkeys(frame["node"]))
        states = [[0.0] * k for _ in nodes]
        place = {n: i for i, n in enumerate(nodes)}
        for n, b, t in zip(frame["node"], frame["bin"], frame["total"]):
            states[place[n]][b] = float(t)
        totals, into = _differenced(states)
        return pd.DataFrame([(n, b, int(frame["up"].iloc[0]), into[i][b], totals[into[i][b]]) for i, n in enumerate(nodes) for b in range(k)], columns=["node", "bin", "up", "to", "total"])

    kinds = ", ".join(f"`{x}` {df.schema[x].dataType.simpleString()}" for x in keep)
    found = settled(rows.groupBy("node").applyInPandas(placed, f"{kinds}, node long, bin int"))
    states = found.groupBy("node", "bin").agg(F.sum(F.col(length).cast("double")).alias("total"))
    while states.agg(F.max("node")).first()[0]:  # a row for each batch of rows, then for each batch of these
        moved = settled(states.withColumn("up", F.floor(F.col("node") / batch)).groupBy("up").applyInPandas(lifted, "node long, bin int, up long, to int, total double"))
        found = found.join(moved.select("node", "bin", "up", "to"), ["node", "bin"]).select(*keep, F.col("up").alias("node"), F.col("to").alias("bin"))
        states = moved.select(F.col("up").alias("node"), F.col("to").alias("bin"), "total").distinct()
    return found.select(key, "bin", length)


def greedy_bins(df: DataFrame, key: str, length: str, k: int) -> DataFrame:
    """(key, bin, length) for all rows: by the key, each to the lightest bin (the first of equal ones). The rows stream
    through one task in order, and only the bins' totals are kept."""

    def placed(frames: Iterator):
        heap = [(0, b) for b in range(k)]
        for frame in frames:
            out = []
            for n in frame[length]:
                total, b = heap[0]
                heapq.heapreplace(heap, (total + int(n), b))
                out.append(b)
            yield frame.assign(bin=out)[[key, "bin", length]]

    return df.select(key, length).coalesce(1).sortWithinPartitions(key, length).mapInPandas(placed, _binned(df, key, length))


def _binned(df: DataFrame, key: str, length: str) -> str:
    kind = lambda x: f"`{x}` {df.schema[x].dataType.simpleString()}"
    return f"{kind(key)}, bin int, {kind(length)}"


def micro_batches(lengths: list[float], most: float) -> list[list[int]]:
    """As many balanced bins as the total needs at `most` each."""
    return differencing_partition(lengths, max(1, -(-int(sum(lengths)) // int(most))))


def micro_batched(df: DataFrame, key: str, length: str, most: float) -> DataFrame:
    """(key, bin, length): as many balanced bins as the total needs at `most` each. The lengths are settled, so that what
    they are taken from is read once."""
    df = settled(df.select(key, length))
    total = df.agg(F.sum(F.col(length).cast("double"))).first()[0] or 0.0
    return balanced_bins(df, key, length, max(1, math.ceil(total / most)))


def imbalance(df: DataFrame, part: str, length: str) -> DataFrame:
    sums = df.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("least"), F.max("s").alias("most"), F.avg("s").alias("mean"))


def shard_cover(shards: list[tuple[str, int, set]], wanted: set) -> list[str]:
    """Names of the shards that cover all wanted items, by fewest bytes, then fewest shards, then names; none if they cannot.

    Weighted set cover on bit sets: shards that another covers at no more bytes (and a name before theirs on ties) go first; then
    branch and bound on the item that the fewest shards hold. The bound shares each shard's bytes out over the open items that it
    holds. What is reached again at a worse cost is left. Runs on the driver: over shards, of which there are some tens."""
    places = {x: 1 << k for k, x in enumerate(sorted(wanted, key=repr))}
    everything = (1 << len(places)) - 1
    masks = [(name, size, sum(places[x] for x in items if x in places)) for name, size, items in sorted(shards, key=lambda s: (s[1], s[0]))]
    kept: list[tuple[str, int, int]] = []
    for name, size, mask in masks:  # in the order of bytes and names, so only earlier ones can replace one
        if mask and not any(mask & ~other == 0 for _, _, other in kept):
            kept.append((name, size, mask))
    holders = [[s for s in kept if s[2] >> k & 1] for k in range(len(places))]
    if not all(holders):
        return []
    best: tuple | None = None
    seen: dict[int, tuple] = {}

    def bound(left: int) -> float:
        share = {s[0]: s[1] / (s[2] & left).bit_count() for s in kept if s[2] & left}
        return sum(min(share[s[0]] for s in holders[k]) for k in range(len(places)) if left >> k & 1)

    def search(left: int, size: int, picked: tuple) -> None:
        nonlocal best
        cost = (size, len(picked), sorted(picked))
        if left in seen and seen[left] <= cost:
            return
        seen[left] = cost
        if not left:
            best = cost if best is None or cost < best else best
            return
        if best is not None and size + bound(left) > best[0] * (1 + 1e-12) + 1e-9:
            return
        k = min((k for k in range(len(places)) if left >> k & 1), key=lambda k: (len(holders[k]), k))
        for name, more, mask in sorted(holders[k], key=lambda s: (s[1] / (s[2] & left).bit_count(), s[0])):
            search(left & ~mask, size + more, (*picked, name))

    search(everything, 0, ())
    return best[2] if best else []
