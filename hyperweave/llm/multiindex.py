"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, and the pairs of codes are the
cells of a grid. A vector lies in its home cell and visits others, nearest first: for each half the codes are ordered by
how far the vector is from the border to that code's cell, and the cells follow in the order of the two distances' sum of
squares, until the target recall is reached.

How far that is. Vectors that link are no further apart than d, d * d = 2 - 2 * threshold. If they lie in different
cells, the border of each half parts them, so their distances to it add up to what they are apart there at most. One of
the two therefore has both distances' squares below d * d / 2 together, or d * d / 4 where one half is shared, and finds
the other's cell. With a recall of 1, which is the default, all these cells are visited and no link is lost; below 1,
only as far as that share of links is apart across a border if links lie in all directions alike. What meets in a cell is
verified by the cosine in double precision.

Equal vectors of one label meet once. Cells of more than `CELL` residents or `VISITS` visitors are dealt out in blocks of
both, each pair of blocks a group of its own. No pair of a group is emitted: a group gives for every vector the number
of its links and the smallest number that its links reach inside the group. In a neighbourhood that is dense as a whole
the pairs verified (but not the rows moved between tasks, which are its blocks) grow with its square, since links are to be counted.

Contract. A vector that is null, zero or empty, or that holds null or non-finite components, links with nothing, nor does
a row with a null label or a null id; such rows are returned with no links and themselves as their component (null for a
null id) and are kept. Vectors of different lengths do not link. Repeated ids count as separate rows. Ties at the
threshold link. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .centroids import by_width, k_means, squared_distances
from .common import settled, ship
from .permutation import scaled

#: Rows that the codebooks are fitted on (those of the smallest hashes), and codes of a half: one for each `PER_CODE` in the root.
SAMPLED, MOST_CODES, PER_CODE = 16_384, 256, 512
#: Residents and visitors of a block.
CELL, VISITS = 1024, 4096


def usable(column: str):
    """Whether a vector takes part."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


class Grid:
    """Codebooks of both halves of the vectors of one length."""

    def __init__(self, unit: np.ndarray, codes: int):
        self.half = unit.shape[1] // 2
        self.books = [k_means(x, codes) for x in (unit[:, : self.half], unit[:, self.half :])]
        self.between = [np.sqrt(squared_distances(b, b)) for b in self.books]

    def _borders(self, x: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest code of each row, and the squared distances to the borders of the other codes' cells."""
        apart = squared_distances(x, self.books[side])
        home = apart.argmin(1)
        gap = apart - np.take_along_axis(apart, home[:, None], 1)
        between = self.between[side][home]
        return home, np.square(np.divide(gap, 2 * between, out=np.zeros_like(gap), where=between > 0))

    def cells(self, unit: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cells, and of every row the cells that it visits, nearest first, its home among them.

        limit: of the sum of squares where both codes differ from the home's; half of it where one does."""
        sides = [self._borders(unit[:, : self.half], 0), self._borders(unit[:, self.half :], 1)]
        width = len(self.books[1])
        order = [np.argsort(border, axis=1, kind="stable") for _, border in sides]
        first, second = (np.take_along_axis(border, o, 1) for (_, border), o in zip(sides, order))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(first.shape[1]):  # the i-th code of the first half, with the codes of the second in their order
            left = limit - first[:, i]
            if not (left >= 0).any():
                break
            for j in range(second.shape[1]):
                whole = first[:, i] + second[:, j]
                one = (order[0][:, i] == sides[0][0]) | (order[1][:, j] == sides[1][0])
                if not (second[:, j] <= left).any():
                    break
                row = np.flatnonzero(whole <= np.where(one, limit / 2, limit))
                found.append((row, whole[row], order[0][row, i] * width + order[1][row, j]))
        row, apart, cell = (np.concatenate(x) for x in zip(*found))
        home = sides[0][0] * width + sides[1][0]
        by = np.lexsort((cell, apart, row))
        return home, np.split(cell[by], np.searchsorted(row[by], np.arange(1, len(unit))))


def reach(threshold: float, width: int, recall: float) -> float:
    """The limit of Grid.cells."""
    whole = (2 - 2 * threshold) / 2 * (1 + 1e-9) + 1e-12
    if recall >= 1:
        return whole
    # a link's component across a border is normal, of the links' length over the root of the dimensions; half of it lies on one's own side
    across = NormalDist().inv_cdf((1 + recall) / 2) * math.sqrt((2 - 2 * threshold) / width) / 2
    return min(whole, 2 * across * across)


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, scaled by powers of two, and their lengths."""
    v = scaled(column.flatten().to_numpy().astype(float).reshape(len(column), width))
    return v, np.sqrt((v * v).sum(1))


def _homes(reps: DataFrame, grids, threshold: float, recall: float) -> DataFrame:
    """reps with width, home and visits; a length without codebooks has one cell."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for w in map(int, np.unique(widths)):
                own = batch.filter(pa.array(widths == w))
                home, visits = np.zeros(own.num_rows, np.int64), [np.zeros(1, np.int64)] * own.num_rows
                if w in grids.value:
                    v, size = _unit(own.column("v"), w)
                    home, visits = grids.value[w].cells(v / size[:, None], reach(threshold, w, recall))
                offsets = np.cumsum([0, *map(len, visits)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(visits).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.full(len(home), w, np.int32)), pa.array(home.astype(np.int32)), lists], [*own.schema.names, "width", "home", "visits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(placed, f"{kinds}, width int, home int, visits array<int>")


def _dealt(homes: DataFrame) -> DataFrame:
    """A row for each meeting of a vector with a block of a cell: group, whether it is a resident there, whether a visitor."""
    meets = homes.withColumn("cell", F.explode("visits"))
    at = ["label", "width", "cell"]
    counts = meets.groupBy(*at).agg(F.count("*").alias("n_v"), F.count(F.when(F.col("cell") == F.col("home"), 1)).alias("n_r"))
    counts = counts.where("n_r > 0 AND n_v > 1").selectExpr(*at, f"cast(ceil(n_r / {CELL}) AS int) AS r_blocks", f"cast(ceil(n_v / {VISITS}) AS int) AS v_blocks")
    met = meets.join(counts, at)
    block = "cast(pmod(xxhash64(rep), {}) AS int)"
    one = "array(named_struct('r', 0, 'v', 0, 'lives', cell = home, 'asks', true))"
    asks = f"transform(sequence(0, r_blocks - 1), i -> named_struct('r', i, 'v', {block.format('v_blocks')}, 'lives', false, 'asks', true))"
    lives = f"transform(sequence(0, v_blocks - 1), i -> named_struct('r', {block.format('r_blocks')}, 'v', i, 'lives', true, 'asks', false))"
    places = f"CASE WHEN r_blocks = 1 AND v_blocks = 1 THEN {one} WHEN cell = home THEN concat({asks}, {lives}) ELSE {asks} END"
    met = met.withColumn("place", F.explode(F.expr(places)))
    return met.select(*at, F.col("place.r").alias("r"), F.col("place.v").alias("w"), F.col("place.lives").alias("lives"), F.col("place.asks").alias("asks"), "rep", "n", "home", F.when(F.col("place.lives"), F.col("visits")).alias("visits"), "v")


def _joined(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest number of each side's component, rows a and columns b linked as given."""
    last = np.iinfo(np.int64).max
    while True:
        a_next = np.minimum(a, np.where(linked, b, last).min(1))
        b_next = np.minimum(b, np.where(linked, a_next[:, None], last).min(0))
        if (a_next == a).all() and (b_next == b).all():
            return a, b
        a, b = a_next, b_next


def _group(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(rep, links, smallest number reached) of what links in one group.

    A visitor counts its links; a resident counts those with visitors whose home it does not visit itself."""
    lives, asks = (rows[c].to_numpy() for c in ("lives", "asks"))
    if not lives.any():
        return None
    v, size = _unit(rows["v"].combine_chunks(), len(rows["v"][0]))
    rep, n, home, cell = (rows[c].to_numpy() for c in ("rep", "n", "home", "cell"))
    here, there = np.flatnonzero(lives), np.flatnonzero(asks)
    linked = (v[there] @ v[here].T) / (size[there][:, None] * size[here])
    near = np.abs(linked - threshold) < 1e-9
    if near.any():  # the sum's order decides: as the definition has it
        i, j = np.nonzero(near)
        linked[i, j] = (v[there[i]] * v[here[j]]).sum(1) / (size[there[i]] * size[here[j]])
    linked = (linked >= threshold) & (rep[there][:, None] != rep[here])
    rows_, columns = linked.any(1), linked.any(0)
    if not rows_.any():
        return None
    there, here, linked = there[rows_], here[columns], linked[np.ix_(rows_, columns)]
    visits = rows["visits"].take(pa.array(here)).to_pylist()
    unseen = linked.copy()
    for k in np.unique(home[there]):
        own = home[there] == k
        unseen[np.ix_(own, [k == cell[0] or k in x for x in map(set, visits)])] = False
    a, b = _joined(linked, rep[there], rep[here])
    return np.concatenate([rep[there], rep[here]]), np.concatenate([linked @ n[here], n[there] @ unseen]), np.concatenate([a, b])


def _met(dealt: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, low) from every group."""
    keys = ["label", "width", "cell", "r", "w"]
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if (found := _group(table, threshold)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["rep", "links", "low"])

        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            cut = np.zeros(max(0, held.num_rows - 1), bool)
            for c in keys:
                cut |= np.diff(held[c].to_numpy()) != 0
            at = [0, *(np.flatnonzero(cut) + 1)]
            for a, b in zip(at[:-1], at[1:]):
                yield from done(held.slice(a, b - a))
            held = held.slice(at[-1])
        if held is not None and held.num_rows:
            yield from done(held)

    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(met, "rep long, links long, low long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 1.0, key: str = "vec_id", vector: str = "embedding", label: str = "label", codes: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept), a row for each row."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    able = usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull()
    reps = rows.where(able).groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = settled(reps.withColumn("rep", F.monotonically_increasing_id()))
    if codes is None:
        codes = min(MOST_CODES, max(2, math.isqrt(reps.count() // PER_CODE)))
    sample = reps.orderBy(F.xxhash64("v"), "v").select("v").limit(SAMPLED).collect()

    def grid(x: np.ndarray, k: int) -> Grid:
        x = scaled(x)
        return Grid(x / np.sqrt((x * x).sum(1, keepdims=True)), k)

    grids = spark.sparkContext.broadcast({w: g for w, g in by_width([r.v for r in sample], codes, grid).items()})
    homes = settled(_homes(reps, grids, threshold, recall))
    met = settled(_met(_dealt(homes), threshold))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = settled(components(met.where("rep <> low"), "rep", "low"))
    ids = reps.select(F.col("rep").alias("node"), "id").join(parts, "node")
    least = ids.groupBy("component").agg(F.min("id").alias("least"))
    named = settled(parts.join(least, "component").select(F.col("node").alias("rep"), "least"))
    told = reps.join(counts, "rep", "left").join(named, "rep", "left").where("n > 1 OR links > 0")
    told = told.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "id").alias("least"))
    found = rows.where(able).join(told, ["label", "v"], "left").unionByName(rows.where(~able), allowMissingColumns=True)
    component = F.coalesce("least", "id")
    return found.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
