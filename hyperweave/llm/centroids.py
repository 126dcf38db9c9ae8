"""K-means over a bounded sample, for the operators that keep vectors in lists."""

from __future__ import annotations

import numpy as np

ROUNDS = 8


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centroid."""
    out = (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)
    return np.maximum(out, 0)


def k_means(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k distinct centroids of the sample's rows. The start is drawn, with a fixed seed, by squared distance to what is drawn already."""
    draw, apart, chosen = np.random.default_rng(0), np.full(len(sample), np.inf), [0]
    while True:
        apart = np.minimum(apart, squared_distances(sample, sample[chosen[-1:]])[:, 0])
        if len(chosen) >= k or not apart.any():
            break
        chosen.append(int(np.searchsorted(np.cumsum(apart), draw.random() * apart.sum(), "right").clip(0, len(sample) - 1)))
    centroids = sample[chosen].astype(float)
    for _ in range(rounds):
        near = squared_distances(sample, centroids).argmin(1)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def by_width(vectors: list, k: int, of=lambda x: x) -> dict[int, object]:
    """of(rows of one length, their share of k) for each length in the sample."""
    held: dict[int, list] = {}
    for v in vectors:
        held.setdefault(len(v), []).append(v)
    return {w: of(np.array(x, float).reshape(len(x), w), max(1, k * len(x) // len(vectors))) for w, x in held.items()}
