"""Removal of long repeated byte strings with suffix arrays, over a corpus that no single array could hold.

1. Anchors. Of the short strings inside every window of `length` bytes, the one with the smallest hash (leftmost on
   ties) is its anchor. Equal windows have equal anchors at equal offsets, so only windows whose anchors occur again can
   repeat, and equal windows meet where their anchor's hash leads. Consecutive windows with one anchor are a fragment.
2. Fragments that are equal as a whole repeat as a whole; nothing has to be ordered for that. Where an anchor has
   different fragments, one of each kind is cut from its text and they meet in a block.
3. In a block, windows whose fingerprints nobody shares drop out (that loses nothing), and of the runs left the suffix
   array is built by linear grouping. Neighbours in it that agree in `length` bytes are repeats.
4. An anchor with more than `CROWD` different fragments would not fit a block: its windows meet one by one, dealt by
   128-bit fingerprints.

Contract. Texts are UTF-8 bytes, null is empty, and no match crosses documents; a string may repeat inside its own
document. Strings are judged on the input, not on what is left. Rows that agree in id and text are copies of each other
like any others. A null id is a row like others. An empty table gives no rows. Extra columns are ignored. Between the
steps a document goes by 96 hash bits of its id and text. Fragments of one anchor count as equal when their length, the
anchor's place in them and 62 bits of two polynomials modulo a prime agree; their bytes are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, texts
from .grouping import suffix_array
from .shingles import mix

#: Bytes of a repeated string, and of an anchor.
LENGTH, ANCHOR = 200, 32
#: Bytes hashed at once; longer texts are cut, with an overlap of a window.
PIECE = 1 << 20
#: Anchors in one bucket, and different fragments of one anchor that may meet in a block.
BUCKET, CROWD = 250_000, 2000
#: Fragments whose windows are looked at together.
AT_ONCE = 4000
#: Equal fragments (or windows) that one task meets from which it decides them itself and sends one on for all.
HOT = 4
_CODES = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Fingerprints are polynomials modulo a prime, two in each; four bases, codes of the bytes for each.
_PRIME = (1 << 31) - 1
_BASES = (1_145_141_919, 810_893_364, 1_907_231_117, 523_987_211)
_VALUES = np.random.default_rng(11).integers(1, _PRIME, (4, 256), dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)
_MARK = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("salt", "<i4"), ("start", "<i8"), ("print", "<u8"), ("n", "<i4")])
_FOUND = np.dtype([("doc", "<i8"), ("salt", "<i4"), ("anchor", "<u8"), ("start", "<i8"), ("n", "<i4"), ("kind", "<i4")])
_WINDOW = np.dtype([("print", "<u8"), ("other", "<u8"), ("doc", "<i8"), ("salt", "<i4"), ("start", "<i8"), ("many", "?")])
SPAN, ASK, ASK_CROWD = 0, 1, 2
FRAGMENTS, WINDOWS, DONE = 0, 1, 2
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first powers of the base modulo the prime, more than n."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        size = max(n + 1, 1 << 16)
        held = np.ones(1, np.uint64)
        while len(held) < size:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), _PRIME)) % np.uint64(_PRIME)])
        _powers[base] = held
    return held


class Prints:
    """Fingerprints (62 bits) of any ranges of some bytes, equal for equal ranges wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.halves = []
        for k in (2 * which, 2 * which + 1):
            term = _VALUES[k][data] * _power(_BASES[k], len(data))[: len(data)]
            term = (term & np.uint64(_PRIME)) + (term >> np.uint64(31))  # below 2^32: sums of 2^32 bytes do not overflow
            self.halves.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)]), _power(pow(_BASES[k], -1, _PRIME), len(data))))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        (a, x), (b, y) = self.halves
        p = np.uint64(_PRIME)
        high, low = (a[stop] - a[start]) % p * x[start] % p, (b[stop] - b[start]) % p * y[start] % p
        return mix((high << np.uint64(31) | low) ^ mix((stop - start).astype(np.uint64)))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (bounds: their starts, each a byte after the last one's end): the anchors' hashes, the
    texts that they are in, their fragments' first windows, numbers of windows and fingerprints."""
    w = length - ANCHOR + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < length:
        return none
    h, n, p = _CODES[0][data], 1, _BASE[0]
    while n < ANCHOR:
        h = h[:-n] * np.uint64(p) + h[n:]
        p, n = p * p % (1 << 64), 2 * n
    h = mix(h)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-(-len(h) // w) * w, ~np.uint64(0))
    pad[: len(h)] = low
    rows = pad.reshape(-1, w)
    ahead, back = np.minimum.accumulate(rows, 1).ravel(), np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    windows = len(h) - w + 1
    at = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & _LOW).astype(np.int64)
    # a window's bytes lie in one text
    inside = np.zeros(windows + 1, np.int8)
    stops = np.append(bounds[1:], len(data) + 1) - 1
    some = stops - bounds >= length
    np.add.at(inside, bounds[some], 1)
    np.add.at(inside, np.minimum(stops[some] - length + 1, windows), -1)
    inside = np.cumsum(inside[:-1]) > 0
    first = np.flatnonzero(inside & np.concatenate([[True], (at[1:] != at[:-1]) | ~inside[:-1]]))
    if not len(first):
        return none
    last = np.flatnonzero(inside & np.concatenate([(at[1:] != at[:-1]) | ~inside[1:], [True]]))
    prints = Prints(data).of(first, last + length) + (at[first] - first).astype(np.uint64) * np.uint64(_BASE[1])
    return h[at[first]], np.searchsorted(bounds, first, "right") - 1, first, last - first + 1, mix(prints)


def _pieces(values: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(places, offsets, pieces) of at most about PIECE bytes together; pieces of a text overlap by a window less a byte."""
    held, size = ([], [], []), 0
    for k, v in enumerate(values):
        for at in range(0, max(len(v) - length + 1, 0), PIECE):
            part = v[at : at + PIECE + length - 1]
            for x, y in zip(held, (k, at, part)):
                x.append(y)
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = ([], [], []), 0
    if size:
        yield held


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"\n".join(parts), np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]


def _packed(rows: np.ndarray, by: np.ndarray, buckets: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """rows dealt to buckets by a hash, each bucket's in one value."""
    bucket = (mix(by.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    if len(cuts):
        values = [rows[order[a:b]].tobytes() for a, b in zip(cuts, [*cuts[1:], len(order)])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), pa.array(values, pa.binary())], names)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, kind: np.dtype) -> np.ndarray:
    held = [np.frombuffer(x, kind) for batch in batches for x in batch.column(column).to_pylist()]
    return np.concatenate(held) if held else np.zeros(0, kind)


def _hot(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with these keys: which agree with HOT or more, and which of those goes on for them."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    hot = np.zeros(len(order), bool)
    group = np.cumsum(new) - 1
    hot[order] = (np.bincount(group) >= HOT)[group] if len(order) else False
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    return hot, hot & first


def _found(rows: np.ndarray, kind: int = SPAN) -> np.ndarray:
    out = np.zeros(len(rows), _FOUND)
    for c in set(rows.dtype.names) & {"doc", "salt", "anchor", "start", "n"}:
        out[c] = rows[c]
    out["kind"] = kind
    return out


def _apart(packed: Iterator[pa.RecordBatch], found: bool) -> Iterator[pa.RecordBatch]:
    """(bucket, rows, found) from (bucket, rows): what is still to be met, or what is found already."""
    for b in packed:
        none = pa.nulls(b.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), *((none, b.column(1)) if found else (b.column(1), none))], ["bucket", "rows", "found"])


def _marks(docs: DataFrame, buckets: int, doc_buckets: int, length: int) -> DataFrame:
    """Fragments by anchor. A task that meets many equal ones says itself that they repeat, and sends one, with its number
    of windows below 0, so that no task gets all copies of a frequent passage."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for places, offsets, parts in _pieces(texts(batch.column(2)), length):
                data, bounds = _laid(parts)
                h, text, first, n, prints = anchors(data, bounds, length)
                rows = np.zeros(len(h), _MARK)
                own = np.array(places)[text]
                rows["anchor"], rows["doc"], rows["salt"], rows["print"], rows["n"] = h, keys[own], salts[own], prints, n
                rows["start"] = first - bounds[text] + np.array(offsets)[text]
                hot, sent = _hot(rows["print"], rows["anchor"])
                out = _found(rows[hot])
                yield from _apart(_packed(out, out["doc"].view(np.uint64), doc_buckets, ["bucket", "rows"]), True)
                rows["n"][sent] *= -1
                rows = rows[~hot | sent]
                yield from _apart(_packed(rows, rows["anchor"], buckets, ["bucket", "rows"]), False)

    return docs.select("key", "salt", "text").mapInArrow(mapped, "bucket int, rows binary, found binary")


def _meet(marks: DataFrame, buckets: int, doc_buckets: int, crowd: int) -> DataFrame:
    """What the anchors that occur again say: whole fragments that repeat, and fragments to be looked at."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            done = batch.filter(batch.column(2).is_valid())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(0), done.column(2)], ["bucket", "rows"])
            held.append(batch.filter(batch.column(1).is_valid()))
        rows = _gathered(iter(held), 1, _MARK)
        rows = rows[np.lexsort((rows["start"], rows["salt"], rows["doc"], rows["print"], rows["anchor"]))]
        if not len(rows):
            return
        new_anchor = np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]])
        new_print = new_anchor | np.concatenate([[True], rows["print"][1:] != rows["print"][:-1]])
        group, kind = np.cumsum(new_anchor) - 1, np.cumsum(new_print) - 1
        kinds = np.bincount(group, new_print)[group]
        many = (np.bincount(kind)[kind] > 1) | (np.bincount(kind, rows["n"] < 0)[kind] > 0)
        rows["n"] = np.abs(rows["n"])
        ask = new_print & (kinds > 1)
        asked = _found(rows[ask], ASK)
        asked["kind"][kinds[ask] > crowd] = ASK_CROWD
        out = np.concatenate([_found(rows[many]), asked])
        yield from _packed(out, out["doc"].view(np.uint64), doc_buckets, ["bucket", "rows"])

    return marks.repartition(buckets, "bucket").mapInArrow(mapped, "bucket int, rows binary")


def _merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The union of [start, stop) ranges as sorted disjoint runs."""
    if not len(start):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return np.stack([start[new], reach[np.append(np.flatnonzero(new)[1:], len(start)) - 1]], 1)


def _by_doc(found: DataFrame, doc_buckets: int, length: int) -> DataFrame:
    """(key, salt, spans, asks): each document's repeated ranges, and the fragments of it that are asked for."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches, 1, _FOUND)
        rows = rows[np.lexsort((rows["salt"], rows["doc"]))]
        cuts = np.flatnonzero(np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["salt"][1:] != rows["salt"][:-1])])) if len(rows) else []
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            own = rows[a:b]
            spans, asks = own[own["kind"] == SPAN], own[own["kind"] != SPAN]
            out.append((int(own["doc"][0]), int(own["salt"][0]), _merged(spans["start"], spans["start"] + spans["n"] + length - 1).tobytes(), asks.tobytes() or None))
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 10_000]), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["key", "salt", "spans", "asks"])

    return found.repartition(doc_buckets, "bucket").mapInArrow(mapped, "key long, salt int, spans binary, asks binary")


def _runs_of(w: np.ndarray) -> np.ndarray:
    """Windows as spans, consecutive ones together."""
    w = w[np.lexsort((w["start"], w["salt"], w["doc"]))]
    if not len(w):
        return np.zeros(0, _FOUND)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(w["start"]) != 1) | (w["doc"][1:] != w["doc"][:-1]) | (w["salt"][1:] != w["salt"][:-1])]))
    out = _found(w[new])
    out["n"] = np.diff([*new, len(w)])
    return out


def _cut(asked: DataFrame, buckets: int, doc_buckets: int, length: int) -> DataFrame:
    """Asked-for fragments with their texts, by anchor; of crowded anchors the windows, by fingerprint, those that one
    task meets often decided there and sent once."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["bucket", "what", "rows", "texts"], (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        for batch in batches:
            fragments: dict[int, tuple[list, list]] = {}
            crowded = []
            for text, asks in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                rows = np.frombuffer(asks, _FOUND)
                bucket = (mix(rows["anchor"]) % np.uint64(buckets)).astype(int)
                for k in np.flatnonzero(rows["kind"] == ASK):
                    held = fragments.setdefault(int(bucket[k]), ([], []))
                    held[0].append(rows[k : k + 1])
                    held[1].append(text[rows["start"][k] : rows["start"][k] + rows["n"][k] + length - 1])
                rows = rows[rows["kind"] == ASK_CROWD]
                if len(rows):
                    data = np.frombuffer(text, np.uint8)
                    starts = np.repeat(rows["start"] - np.cumsum(rows["n"]) + rows["n"], rows["n"]) + np.arange(rows["n"].sum())
                    windows = np.zeros(len(starts), _WINDOW)
                    windows["doc"], windows["salt"], windows["start"] = rows["doc"][0], rows["salt"][0], starts
                    for which, c in enumerate(("print", "other")):
                        windows[c] = Prints(data, which).of(starts, starts + length)
                    crowded.append(windows)
            out = [(b, FRAGMENTS, np.concatenate(r).tobytes(), b"".join(t)) for b, (r, t) in fragments.items()]
            if crowded:
                windows = np.concatenate(crowded)
                hot, sent = _hot(windows["other"], windows["print"])
                windows["many"] = sent
                done, windows = _runs_of(windows[hot]), windows[~hot | sent]
                for what, rows, by, n in ((WINDOWS, windows, windows["print"], buckets), (DONE, done, done["doc"].view(np.uint64), doc_buckets)):
                    for part in _packed(rows, by, n, ["bucket", "rows"]):
                        out += [(b, what, r, b"") for b, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return asked.select("text", "asks").mapInArrow(mapped, "bucket int, what int, rows binary, texts binary")


def repeated_windows(runs: list[bytes], length: int) -> list[np.ndarray]:
    """Of different strings: the starts of their windows of `length` bytes that occur twice among all of them, by the
    suffix array of all."""
    joined, owner, offset = [], [], []
    for k, r in enumerate(runs):
        joined += [*(b + 1 for b in r), 0]  # 0 parts the strings
        owner += [k] * (len(r) + 1)
        offset += range(len(r) + 1)
    whole, at = b"\xff".join([*runs, b""]), suffix_array(joined)
    left = [len(runs[k]) - o for k, o in zip(owner, offset)]
    out: list[set] = [set() for _ in runs]
    full = [i for i in at if left[i] >= length]  # shorter ones cannot stand between two that agree in so many bytes
    for i, j in zip(full, full[1:]):
        if whole[i : i + length] == whole[j : j + length]:
            out[owner[i]].add(offset[i])
            out[owner[j]].add(offset[j])
    return [np.array(sorted(x), np.int64) for x in out]


def _block(rows: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Repeated windows of some anchors' fragments, as _FOUND rows. data: their texts end to end, from starts on."""
    n = rows["n"].astype(np.int64)
    group = np.unique(rows["anchor"], return_inverse=True)[1]
    own = np.repeat(np.arange(len(rows)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = starts[own] + step
    prints = mix(Prints(data).of(at, at + length) + group[own].astype(np.uint64) * np.uint64(_BASE[1]))
    order = np.argsort(prints)
    same = prints[order][1:] == prints[order][:-1]
    shared = np.zeros(len(prints), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    first = np.flatnonzero(shared & np.concatenate([[True], ~shared[:-1] | (own[1:] != own[:-1])]))
    last = np.flatnonzero(shared & np.concatenate([~shared[1:] | (own[1:] != own[:-1]), [True]]))
    runs: dict[int, dict[bytes, list]] = {}
    for a, b in zip(first, last):
        runs.setdefault(group[own[a]], {}).setdefault(data[at[a] : at[b] + length].tobytes(), []).append((own[a], step[a], b - a + 1))
    out: list[tuple[int, int, int]] = []  # fragment, first window, windows
    for kinds in runs.values():
        found = repeated_windows(list(kinds), length) if len(kinds) > 1 else [np.zeros(0, np.int64)]
        for members, windows in zip(kinds.values(), found):
            if len(members) > 1:
                out += members
            elif len(windows):
                k, s, _ = members[0]
                cuts = np.flatnonzero(np.diff(windows, prepend=-9) > 1)
                out += [(k, s + windows[a], b - a) for a, b in zip(cuts, [*cuts[1:], len(windows)])]
    which, step, n = np.array(out, np.int64).reshape(-1, 3).T
    found = rows[which]
    found["start"], found["n"], found["kind"] = found["start"] + step, n, SPAN
    return found


def _decide(cut: DataFrame, buckets: int, doc_buckets: int, length: int) -> DataFrame:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, windows = [], [], []
        for batch in batches:
            done = batch.filter(pc.equal(batch.column(1), DONE))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(0), done.column(2)], ["bucket", "rows"])
            for what, r, t in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if what == WINDOWS:
                    windows.append(np.frombuffer(r, _WINDOW))
                elif what == FRAGMENTS:
                    rows.append(np.frombuffer(r, _FOUND))
                    held.append(t)
        found = []
        if rows:
            rows, data = np.concatenate(rows), np.frombuffer(b"".join(held), np.uint8)
            ends = np.cumsum(rows["n"].astype(np.int64) + length - 1)
            starts = ends - rows["n"] - length + 1
            order = np.argsort(rows["anchor"], kind="stable")
            new = np.flatnonzero(np.diff(rows["anchor"][order].view(np.int64), prepend=0))
            cuts, at = [0], 0
            for a, b in zip(new, [*new[1:], len(order)]):  # some anchors at a time
                if b - at > AT_ONCE:
                    cuts.append(int(a))
                    at = a
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                if len(own):
                    part = rows[own]
                    size = part["n"].astype(np.int64) + length - 1
                    base = np.cumsum(size) - size
                    take = np.repeat(starts[own] - base, size) + np.arange(size.sum())
                    found.append(_block(part, data[take], base, length))
        if windows:
            w = np.concatenate(windows)
            w = w[np.lexsort((w["other"], w["print"]))]
            same = (w["print"][1:] == w["print"][:-1]) & (w["other"][1:] == w["other"][:-1])
            found.append(_runs_of(w[np.concatenate([same, [False]]) | np.concatenate([[False], same]) | w["many"]]))
        for out in found:
            yield from _packed(out, out["doc"].view(np.uint64), doc_buckets, ["bucket", "rows"])

    return cut.repartition(buckets, "bucket").mapInArrow(mapped, "bucket int, rows binary")


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, __text, __spans): each document's text and its repeated runs, as binary pairs of starts and stops (bytes)."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length is at least {2 * ANCHOR}")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("__id"), body.alias("text")).withColumns({"key": F.xxhash64("__id", "text"), "salt": F.hash("__id", "text")})
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(n, 2 * total // (length - ANCHOR) // BUCKET)
    doc_buckets = max(n, buckets // 2)
    first = settled(_by_doc(_meet(_marks(rows, buckets, doc_buckets, length), buckets, doc_buckets, crowd), doc_buckets, length))
    asked = rows.select("key", "salt", "text").join(first.where(F.col("asks").isNotNull()).select("key", "salt", "asks"), ["key", "salt"])
    second = settled(_by_doc(_decide(_cut(asked, buckets, doc_buckets, length), buckets, doc_buckets, length), doc_buckets, length))
    spans = first.select("key", "salt", "spans").unionByName(second.select("key", "salt", "spans")).where(F.octet_length("spans") > 0)
    spans = spans.groupBy("key", "salt").agg(F.collect_list("spans").alias("__spans"))  # two of a document at most
    return rows.join(spans, ["key", "salt"], "left").select(F.col("__id").alias(key), F.col("text").alias("__text"), "__spans")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, kept, n_bytes, n_removed, n_spans): the bytes left of each document, and what went."""
    found = find_repeats(docs, key, text, length, crowd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist()):
                runs = np.concatenate([np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans or []] or [np.zeros((0, 2), np.int64)])
                runs = _merged(runs[:, 0], runs[:, 1])
                kept, at = [], 0
                for a, b in runs.tolist():
                    kept.append(value[at:a])
                    at = b
                out.append((b"".join([*kept, value[at:]]), len(value), int((runs[:, 1] - runs[:, 0]).sum()), len(runs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.int64())))], [key, "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema[key].dataType.simpleString()
    return found.select(key, "__text", "__spans").mapInArrow(cut, f"`{key}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
