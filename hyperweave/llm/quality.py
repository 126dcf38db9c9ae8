"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of its own and of its two neighbours; the chain labels it good or bad. A document's raw quality
is the mean of its lines' forward-backward marginals of `good`, weighted by the lines' lengths; a logistic curve, fitted on
the training documents, turns it into the probability of label 1. Inputs are the text alone.

Training: at most `sample` labelled rows (a documented bound; those with the smallest hashes of their ids) that have at
most `lines` lines together (another; in the order of the hashes, a row that no longer fits is passed over), of which only
line features reach the driver. Of rows that share an id, the shortest text trains. Lines of documents labelled 1 are good. Lines of the others start out bad; after a first
fit, those that the chain itself takes for good are relabelled, except for each document's worst line, and it is fitted
again.

Contract. Null text counts as empty; an empty text is one empty line. A row is scored for itself, so repeated rows score
alike. Without labels of both kinds, every score is the share of label 1 (1.0 without labels). Rows with a null id are scored,
and never train. An empty table gives no rows. Extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, ship, texts
from .shingles import CHUNK, _words

#: Labelled rows that the fit may use, and lines that these may have together.
SAMPLE, LINES = 4000, 400_000
#: Score from which a document counts as good.
CUT = 0.3
FEATURES = (
    "log words", "log bytes", "capitals of letters", "digits", "marks", "odd marks", "distinct words", "words like the last", "log word length",
    "words of marks", "words ending in odd marks", "repeated line", "starts with a capital", "ends a sentence",
)
#: Places in FEATURES of what is also taken from the line before and the line after.
NEAR = (2, 4, 5, 6, 7, 9, 10, 11)

_byte = np.arange(256)
_CAPITAL = (_byte >= 65) & (_byte <= 90)
_LETTER = _CAPITAL | (_byte >= 97) & (_byte <= 122) | (_byte >= 128)
_DIGIT = (_byte >= 48) & (_byte <= 57)
_MARK = (_byte > 32) & (_byte < 127) & ~_LETTER & ~_DIGIT
_ODD = _MARK & ~np.isin(_byte, list(b".,;:?'\"()-"))
_END = np.isin(_byte, list(b".?!:;\"'"))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes) of every line of the texts in order, and each text's number of lines."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    stops = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    n = np.diff(np.searchsorted(stops, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    length = stops - starts
    within = lambda table: (c := np.concatenate([[0], np.cumsum(table[data])]))[stops] - c[starts]
    letters, marks, odd, digits, capitals = map(within, (_LETTER, _MARK, _ODD, _DIGIT, _CAPITAL))
    words, at, end = _words(data)
    line = np.searchsorted(stops, at)
    n_words = np.bincount(line, minlength=len(stops))
    some, seen = np.maximum(n_words, 1), np.maximum(letters + marks + digits, 1)
    order = np.lexsort((words, line))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], new, len(stops))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (line[1:] == line[:-1])
    alnum = np.concatenate([[0], np.cumsum((_LETTER | _DIGIT)[data])])
    of_words = lambda flags: np.bincount(line, flags, len(stops)) / some
    sums = np.bincount(line, (words & np.uint64(0xFFFFFFFF)).astype(float) * (1 + np.arange(len(words)) - np.searchsorted(line, line)), len(stops))
    text_of = np.repeat(np.arange(len(texts)), n)
    key = np.lexsort((sums, text_of))
    again = np.zeros(len(stops), bool)
    again[key[1:]] = (sums[key][1:] == sums[key][:-1]) & (text_of[key][1:] == text_of[key][:-1]) & (n_words[key][1:] > 0)
    full = length > 0
    x = np.stack([
        np.log1p(n_words), np.log1p(length), capitals / np.maximum(letters, 1), digits / seen, marks / seen, odd / seen,
        np.where(n_words > 0, distinct / some, 1), of_words(same), np.log1p(of_words(end - at)),
        of_words(alnum[end] == alnum[at]), of_words(_ODD[data[end - 1]] if len(end) else same), again,
        np.where(full, _CAPITAL[data[starts]], 0), np.where(full, _END[data[np.maximum(stops - 1, 0)]], 0),
    ], 1)
    first, last = np.cumsum(n) - n, np.cumsum(n) - 1
    near = x[:, NEAR]
    before, after = np.roll(near, 1, 0), np.roll(near, -1, 0)
    before[first], after[last] = 0, 0
    edge = np.zeros((len(x), 2))
    edge[first, 0], edge[last, 1] = 1, 1
    return np.concatenate([x, before, after, edge, np.ones((len(x), 1))], 1), length, n


def marginals(score: np.ndarray, step: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once: P(good) of each line, expected transitions [2, 2], log partition.

    score: the lines' log odds of good, chain after chain; step: transition scores; n: the chains' lengths (none is 0).
    """
    order = np.argsort(-n, kind="stable")
    start, n = (np.cumsum(n) - n)[order], n[order]
    alive = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")  # chains longer than t
    emit = np.stack([np.zeros_like(score), np.clip(score, -30, 30)], 1)
    emit = np.exp(emit - emit.max(1, keepdims=True))
    move, ahead, back = np.exp(step), np.empty_like(emit), np.ones_like(emit)
    total = 0.0
    for t, k in enumerate(alive):
        at = start[:k] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        z = a.sum(1, keepdims=True)
        ahead[at] = a / z
        total += np.log(z).sum()
    moved = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        after = emit[at] * back[at]
        b = after @ move.T
        pair = ahead[at - 1][:, :, None] * move * after[:, None, :]
        moved += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        back[at - 1] = b / b.sum(1, keepdims=True)
    both = ahead * back
    return both[:, 1] / both.sum(1), moved, total


class LineCrf:
    """Weights of a two-label chain and of the logistic curve over a document's raw quality."""

    def __init__(self):
        self.mean = self.scale = self.weights = None
        self.step, self.curve, self.constant = np.zeros((2, 2)), (0.0, 1.0), None

    def _gradient(self, x, y, n, weight, damp):
        good, moved, _ = marginals(x @ self.weights, self.step, n)
        inner = np.ones(len(y), bool)
        inner[np.cumsum(n) - n] = False
        seen = np.zeros((2, 2))
        k = np.flatnonzero(inner)
        np.add.at(seen, (y[k - 1], y[k]), 1)
        return (x.T @ ((y - good) * weight)) / len(y) - damp * self.weights, (seen - moved) / len(y) - damp * self.step

    def _fit(self, x, y, n, rounds, damp):
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.weights, self.step)]
        for r in range(1, rounds + 1):
            for p, g, s in zip((self.weights, self.step), self._gradient(x, y, n, weight, damp), state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                p += 0.1 * (s[0] / (1 - 0.9**r)) / (np.sqrt(s[1] / (1 - 0.99**r)) + 1e-6)

    def raw(self, x: np.ndarray, length: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each document, as log odds."""
        good, _, _ = marginals(((x - self.mean) / self.scale) @ self.weights, self.step, n)
        own, weight = np.repeat(np.arange(len(n)), n), np.maximum(length, 1)
        mean = np.clip(np.bincount(own, good * weight, len(n)) / np.bincount(own, weight, len(n)), 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def fit(self, x: np.ndarray, length: np.ndarray, n: np.ndarray, labels: np.ndarray, rounds: int = 60, damp: float = 1e-4) -> LineCrf:
        if not 0 < labels.mean() < 1 if len(labels) else True:
            self.constant = float(labels.mean()) if len(labels) else 1.0
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.mean[-1], self.scale[-1] = 0, 1
        self.weights = np.zeros(x.shape[1])
        z, own = (x - self.mean) / self.scale, np.repeat(np.arange(len(n)), n)
        y = labels[own].astype(int)
        self._fit(z, y, n, rounds, damp)
        good, _, _ = marginals(z @ self.weights, self.step, n)
        worst = np.full(len(n), np.inf)
        np.minimum.at(worst, own, good)
        y = np.where((labels[own] == 1) | (good > 0.5) & (good > worst[own]), 1, 0)
        self._fit(z, y, n, rounds, damp)
        raw = self.raw(x, length, n)
        a, b = 0.0, 1.0
        for _ in range(30):  # Newton steps of a logistic curve, slightly damped
            p = 1 / (1 + np.exp(-np.clip(a + b * raw, -30, 30)))
            g = np.array([(labels - p).sum(), ((labels - p) * raw).sum() - 1e-2 * b])
            w = p * (1 - p)
            h = np.array([[w.sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), (w * raw * raw).sum() + 1e-2]])
            da, db = np.linalg.solve(h, g)
            a, b = a + np.clip(da, -2, 2), b + np.clip(db, -2, 2)
        self.curve = (a, max(b, 0.0))
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant)
        out, held, size = [], [], 0
        for k, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= CHUNK or k == len(texts) - 1:
                a, b = self.curve
                out.append(1 / (1 + np.exp(-np.clip(a + b * self.raw(*line_features(held)), -500, 500))))
                held, size = [], 0
        return np.concatenate(out)


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learnt: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, lines: int = LINES) -> LineCrf:
    """A chain fitted on at most `sample` labelled rows with at most `lines` lines that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)  # the bound of what is broadcast

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, y in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                x, length, _ = line_features([t])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([int(y)], pa.int32()), pa.array([x.astype(np.float32).tobytes()]), pa.array([length.astype(np.int64).tobytes()])], ["k", "y", "x", "length"])

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(known), "k")
    rows = settled(rows.groupBy(F.col("k").cast("long").alias("k")).agg(F.min("y").alias("y"), F.min(F.struct(F.length("t").alias("n"), "t")).alias("x")).select("k", "y", "x.t"))
    sizes = rows.select("k", (F.octet_length("t") - F.octet_length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).alias("n"), F.xxhash64("k").alias("h")).collect()  # at most `sample`
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.k)):
        if total + r.n <= lines:
            chosen.append((r.k,))
            total += r.n
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "k long")), "k", "left_semi").select("k", "t", "y")
    rows = sorted(rows.mapInArrow(features, "k long, y int, x binary, length binary").collect(), key=lambda r: (r.k, bytes(r.x)))
    length = [np.frombuffer(r.length, np.int64) for r in rows]
    if not rows:
        return LineCrf().fit(np.zeros((0, 1)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(len(n), -1) for r, n in zip(rows, length)]).astype(float)
    return LineCrf().fit(x, np.concatenate(length), np.array([len(n) for n in length]), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: LineCrf, text: str = "text", into: str = "score") -> DataFrame:
    """docs with the column `into`: the probability of label 1."""
    ship(docs.sparkSession)
    held, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), [*docs.columns, into]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(texts(batch.column(at))), pa.float64())], names)

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """docs, same columns, without those that the chain rejects."""
    return score(docs, train(docs, labels, key, text), text, "__score").where(F.col("__score") >= cut).select(docs.columns)
