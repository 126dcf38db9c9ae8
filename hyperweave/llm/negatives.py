"""Hard-negative mining over k-means inverted lists with stored radii.

Rows lie in lists by their nearest centroid, ordered by their distance to it and cut every `LIST` rows, so a list has the
radius of its own rows. Its scores with an anchor q are within <q, centroid> +- |q| * radius (Cauchy and Schwarz). An
anchor visits its list of the highest bound first, then the others, but no list whose bound falls strictly below the
score of its k-th answer so far, and none whose bounds lie outside its windows. The k-th score starts from what a sample
of real rows reaches, and tightens within each task; the tasks' answers are merged.

Two searches follow each other for each slice of at most `SLICE` anchors, which are broadcast: for positives (the label
is the anchor's), then for negatives (it is not), a window of scores for each positive. Rows are dealt by ranges of list,
distance and id, so no list, however large, lies in one task.

Contract. Each component x counts as floor(scale * x), x as double; the score is the integer inner product, and ties go
to the smaller id. A row takes no part whose id, label or vector is null, that holds a null or non-finite component, or
the squared length of which does not fit a long (no score could). Labels are integers. Vectors of different lengths
have no score with each other; empty ones score 0. Repeated ids count as separate rows, except that an anchor never
answers with its own id; anchors that repeat as a whole answer once. With fewer rows than asked for, all are returned.
Negative positive scores have empty windows. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import by_width, k_means, squared_distances
from .common import settled, ship

#: Rows that the centroids are fitted on and the first k-th scores taken from (those of the smallest hashes), and centroids.
SAMPLED, CENTROIDS = 8192, 256
#: Most rows of a list, and rows that a task searches at once.
LIST, GROUP = 1024, 8192
#: Anchors in one broadcast.
SLICE = 8192
#: Below this, sums of products are exact in doubles.
EXACT = 1 << 53
NONE, LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, v as longs."""
    x = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    finite = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 4e9))
    fits = F.aggregate(x, F.lit(0.0), lambda a, x: a + x * x) < 9e18
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.alias("x"))
    return rows.where(finite & fits).select("id", "label", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _listed(sample: list) -> dict[int, np.ndarray]:
    return by_width(sample, CENTROIDS, lambda x, k: k_means(x, min(k, max(1, len(x) // 16))))


def _nearest(books: dict[int, np.ndarray], width: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the nearest centroids and distances to them; a length without centroids has the origin as number -1."""
    if width not in books:
        return np.full(len(v), -1), np.sqrt((v.astype(float) ** 2).sum(1))
    apart = squared_distances(v.astype(float), books[width])
    near = apart.argmin(1)
    return near, np.sqrt(((v - books[width][near]) ** 2).sum(1))


def index(rows: DataFrame, books) -> DataFrame:
    """(width, list, apart, id, label, v), dealt by ranges of list, distance and id and ordered so within each part."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for w in np.unique(widths):
                own = batch.filter(pa.array(widths == w))
                near, apart = _nearest(books.value, int(w), _matrix(own.column(2), int(w)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), w, np.int32)), pa.array(near.astype(np.int32)), pa.array(apart), *own.columns], ["width", "list", "apart", "id", "label", "v"])

    found = settled(rows.mapInArrow(placed, "width int, list int, apart double, id long, label long, v array<long>"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["width", "list", "apart", F.xxhash64("id")]
    return settled(found.repartitionByRange(parts, *order).sortWithinPartitions(*order))


class _List:
    def __init__(self, batch: pa.Table, width: int, centroid: np.ndarray, radius: float):
        ids = batch["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], batch["label"].to_numpy()[order]
        self.v = _matrix(batch["v"].combine_chunks(), width)[order]
        self.centroid, self.radius = centroid, radius
        self.size = np.sqrt((self.v.astype(float) ** 2).sum(1).max(initial=0))


def _lists(group: pa.Table, books: dict[int, np.ndarray]) -> dict[int, list[_List]]:
    """The lists of some ordered rows, by length."""
    out: dict[int, list[_List]] = {}
    width, number = group["width"].to_numpy(), group["list"].to_numpy()
    cuts = np.flatnonzero((np.diff(width) != 0) | (np.diff(number) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(width)]):
        for at in range(a, b, LIST):
            own, w, c = group.slice(at, min(LIST, b - at)), int(width[at]), int(number[at])
            centroid = books[w][c] if c >= 0 else np.zeros(w)
            out.setdefault(w, []).append(_List(own, w, centroid, own["apart"].to_numpy().max() if len(own) else 0.0))
    return out


class Best:
    """The k best answers so far for every row of a matrix of searches: scores and ids, best first. Until real ones are
    there, `least`, a score that k rows are known to reach, stands in."""

    def __init__(self, least: np.ndarray, k: int):
        self.k = k
        self.scores, self.ids = np.repeat(least[:, None], k, 1), np.full((len(least), k), LAST)

    def kth(self) -> np.ndarray:
        return self.scores[:, -1]

    def meet(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """The searches `at` meet rows of these scores and ids where they fit."""
        masked = np.where(fits, scores, NONE)
        least = self.kth()[at]
        if masked.shape[1] > self.k:
            least = np.maximum(least, np.partition(masked, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero(fits & (masked >= least[:, None]))
        if not len(row):
            return
        touched, row = np.unique(row, return_inverse=True)
        own = at[touched]
        rows = np.concatenate([row, np.repeat(np.arange(len(own)), self.k)])
        values = np.concatenate([masked[touched[row], col], self.scores[own].ravel()])
        names = np.concatenate([ids[col], self.ids[own].ravel()])
        order = np.lexsort((names, ~values, rows))
        rows, values, names = rows[order], values[order], names[order]
        first = np.searchsorted(rows, np.arange(len(own)))[:, None] + np.arange(self.k)
        self.scores[own], self.ids[own] = values[first], names[first]


class Anchors:
    """Anchors of one length. windows: (low, high) of scores, each (anchors, searches), for negatives; else positives are searched."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, k: int, windows: tuple[np.ndarray, np.ndarray] | None = None):
        self.numbers, self.ids, self.labels, self.v, self.k, self.windows = numbers, ids, labels, v, k, windows
        self.size = np.sqrt((v.astype(float) ** 2).sum(1))
        self.searches = windows[0].shape[1] if windows else 1
        self.least = np.full((len(ids), self.searches), NONE)

    def scores(self, at: np.ndarray, v: np.ndarray, size: float) -> np.ndarray:
        if self.size[at].max(initial=0) * size < EXACT:
            return (self.v[at].astype(float) @ v.astype(float).T).astype(np.int64)
        return self.v[at] @ v.T

    def meet(self, best: list[Best], at: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, size: float) -> None:
        for part in range(0, len(at), 1024):
            own = at[part : part + 1024]
            scores = self.scores(own, v, size)
            same = self.labels[own][:, None] == labels
            if self.windows is None:
                best[0].meet(own, scores, ids, same & (self.ids[own][:, None] != ids))
                continue
            for j, found in enumerate(best):
                low, high = self.windows[0][own, j], self.windows[1][own, j]
                found.meet(own, scores, ids, ~same & (self.ids[own][:, None] != ids) & (scores >= low[:, None]) & (scores <= high[:, None]))

    def begin(self) -> list[Best]:
        return [Best(self.least[:, j], self.k) for j in range(self.searches)]

    def seed(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """k-th scores that these rows reach."""
        best = self.begin()
        self.meet(best, np.arange(len(self.ids)), ids, labels, v, np.sqrt((v.astype(float) ** 2).sum(1).max(initial=0)))
        self.least = np.stack([b.kth() for b in best], 1)

    def visit(self, best: list[Best], lists: list[_List]) -> None:
        centroids, radii = np.stack([x.centroid for x in lists]), np.array([x.radius for x in lists])
        middle, reach = self.v.astype(float) @ centroids.T, self.size[:, None] * radii
        slack = 1e-6 + 1e-9 * (self.size[:, None] * np.sqrt((centroids * centroids).sum(1)) + reach)
        high, low = middle + reach + slack, middle - reach - slack
        first = high.argmax(1)

        def wanted(k: int, some: np.ndarray) -> np.ndarray:
            ask = np.zeros(len(some), bool)
            for j, found in enumerate(best):
                near = high[some, k] >= found.kth()[some]
                if self.windows:
                    near &= (high[some, k] >= self.windows[0][some, j]) & (low[some, k] <= self.windows[1][some, j])
                ask |= near
            return some[ask]

        for turn in (True, False):
            for k in np.argsort(-high.max(0), kind="stable"):
                at = wanted(k, np.flatnonzero((first == k) == turn))
                if len(at):
                    x = lists[k]
                    self.meet(best, at, x.ids, x.labels, x.v, x.size)


def _answers(indexed: DataFrame, books, anchors: dict[int, Anchors]) -> DataFrame:
    """(number, search, id, score): every task's best answers."""
    sent = indexed.sparkSession.sparkContext.broadcast(anchors)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = sent.value, {}
        held, n = [], 0

        def search() -> None:
            for w, lists in _lists(pa.Table.from_batches(held).combine_chunks(), books.value).items():
                if w in asked:
                    asked[w].visit(best.setdefault(w, asked[w].begin()), lists)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= GROUP:
                search()
                held, n = [], 0
        if n:
            search()
        for w, each in best.items():
            for j, b in enumerate(each):
                row, col = np.nonzero(b.ids != LAST)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[w].numbers[row]), pa.array(np.full(len(row), j, np.int32)), pa.array(b.ids[row, col]), pa.array(b.scores[row, col])], ["number", "search", "id", "score"])

    return indexed.mapInArrow(found, "number long, search int, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number", "search").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, most: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every row of which is_anchor (over
    `id`) holds: its first positives, and of each the first rows of other labels whose scores are from low to high
    percent of the positive's."""
    spark = vectors.sparkSession
    ship(spark)
    rows = settled(usable(vectors, key, vector, label, scale))
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLED).collect()
    books = spark.sparkContext.broadcast(_listed([r.v for r in sample]))
    indexed = index(rows, books)
    anchors = settled(rows.where(is_anchor).distinct())
    slices = max(1, -(-anchors.count() // most))
    answer = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = []
    for part in range(slices):
        asked = anchors.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == part).collect()  # about SLICE rows
        if asked:
            out.append(_mine_slice(indexed, books, asked, sample, positives, negatives, low, high))
    return reduce(DataFrame.unionByName, out).select(*(x.split()[0] for x in answer.split(", "))) if out else spark.createDataFrame([], answer)


def _widths(rows: list) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, ids, labels and vectors of rows, by length."""
    held: dict[int, list] = {}
    for k, r in enumerate(rows):
        held.setdefault(len(r.v), []).append((k, r.id, r.label, r.v))
    return {w: (*(np.array([x[j] for x in own], np.int64) for j in range(3)), np.array([x[3] for x in own], np.int64).reshape(len(own), w)) for w, own in held.items()}


def _mine_slice(indexed: DataFrame, books, asked: list, sample: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark, seeds = indexed.sparkSession, _widths(sample)
    anchors = {w: Anchors(*own, positives) for w, own in _widths(asked).items()}
    for w, a in anchors.items():
        if w in seeds:
            a.seed(*seeds[w][1:])
    found = _best(_answers(indexed, books, anchors), positives).select("number", "rank", "id", "score").collect()  # `positives` for each anchor of the slice
    again = {}
    for w, a in anchors.items():
        place = {int(n): k for k, n in enumerate(a.numbers)}
        bounds = np.full((2, len(place), positives), 0, np.int64)
        bounds[0] += 1  # no positive, an empty window
        for r in found:
            if (k := place.get(r.number)) is not None:
                bounds[:, k, r.rank - 1] = -(-low * r.score // 100), high * r.score // 100
        again[w] = Anchors(a.numbers, a.ids, a.labels, a.v, negatives, (bounds[0], bounds[1]))
        if w in seeds:
            again[w].seed(*seeds[w][1:])
    pairs = [(r.number, r.rank - 1, asked[r.number].id, r.id, r.score) for r in found]
    known = spark.createDataFrame(pairs, "number long, search int, anchor_id long, positive_id long, positive_score long")
    best = _best(_answers(indexed, books, again), negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    return best.join(F.broadcast(known), ["number", "search"])  # a slice's positives at most
