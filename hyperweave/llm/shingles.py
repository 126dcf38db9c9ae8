"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which a word is hashed by BLAKE2b instead of in steps of eight bytes.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in the bytes.

    A word goes into its hash eight bytes at a time, with a bijection after each step, so words of one length
    up to eight bytes never clash, and no family of longer ones does for algebraic reasons, as under a polynomial hash."""
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    hashes = mix(n.astype(np.uint64))
    at, k = np.flatnonzero(n < LONG), 0
    while len(at):
        block = eight[starts[at] + k] & _MASK[np.minimum(n[at] - k, 8)]
        hashes[at] = mix((hashes[at] ^ block) * _STEP)
        k += 8
        at = at[n[at] > k]
    for j in np.flatnonzero(n >= LONG):
        hashes[j] = int.from_bytes(hashlib.blake2b(low[starts[j] : ends[j]].tobytes(), digest_size=8).digest(), "little")
    return hashes, starts, ends


def _chunk(texts: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    words, starts, _ = _words(data)
    at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs = runs * _STEP + words[j : j + n]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:  # the whole sequence, told apart from longer ones by its length
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mix(h * _STEP + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs of anything but ASCII white space, A-Z in lower
    case; a text of fewer words than `size` has its whole sequence as its one shingle, one without words none."""
    out, held, n = [], [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= CHUNK:
            out += _chunk(held, size)
            held, n = [], 0
    return out + (_chunk(held, size) if held else [])
