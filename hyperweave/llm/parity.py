"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into a bit sketch in which every shingle toggles one bit, so two sketches
differ in at most as many bits as the sets have elements in one but not both. Sets of sizes a and b with a Jaccard
similarity of at least t differ in at most (1 - t) / (1 + t) * (a + b) elements.

Size bands bound that: for pairs whose larger set lies in a band, at most D bits differ. The band's sketches have more
than D parts, so two of them agree in a part (pigeonhole); a part's state, coded in 64 bits, is posted. A set is posted
in its own band and in those whose sets it may be the smaller partner of. Empty parts are posted only by documents with
so many of them that the argument would fail otherwise, which loses nothing: two sets of which one has fewer agree in a
part that is not empty.

Of a posted state, the smallest document is the hub; every other one is verified against it on the whole sets (of a hot
state, against the smallest of its slice, and these against the hub). Where all of a hub's documents hold, they are
connected and no pair among them is needed. Where one fails, the hub's documents are compared with each other, in blocks,
on full bit sketches, and what passes is verified too. So no link between different components is lost, no group is
expanded into its pairs, and no task holds all documents of a hot state.

Contract. Null text counts as empty. A document without words has an empty set and no links. Rows that share an id are
one node. A null id takes no part: its row is returned with a null component. Sets are of 64-bit hashes. Ties do not
arise: components are named by their smallest id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import settled, texts
from .shingles import mix, shingle_sets

#: Linking similarity, in hundredths, and words in a shingle.
PERCENT, WORDS = 80, 5
#: Postings in one task's bucket, and documents of a slice from which a state they share is pre-aggregated.
POSTINGS, HOT = 400_000, 4
#: Documents, and bytes of text but for one document, whose sets a worker holds at once.
SLICE, SLICE_BYTES = 400, 4 << 20
#: Places (a power of two) of the fixed-size bitmap of id hashes that spares most documents the second reading.
FILTER_BITS = 24
#: Documents in a block of the last comparison: at least and at most.
BLOCK = (512, 8192)


class Bands:
    """Size bands of one similarity: their bounds, and the parts of their sketches."""

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, -(-low[-1] * 100 // percent)))
        self.low = np.array(low, np.int64)
        high = self.low[1:] - 1
        self.apart = (100 - percent) * 2 * high // (100 + percent)
        self.parts = np.where(self.apart > 0, self.apart + 2 + self.apart // 8, 1)
        self.least = -(-self.low * percent // 100)

    def of(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (places in sizes, their bands), each set's own band first, then those in which it may be smaller."""
        own = np.searchsorted(self.low, sizes, "right") - 1
        step = 0
        while True:
            band = own + step
            at = np.flatnonzero((sizes > 0) & (band < len(self.parts)))
            at = at[sizes[at] >= self.least[band[at]]]
            if not len(at):
                return
            yield at, band[at]
            step += 1


def postings(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(states, places of the sets) of all posted parts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *sizes])[:-1]
    states, owners = [], []
    for at, band in bands.of(sizes):
        n = sizes[at]
        parts = bands.parts[band]
        first = np.concatenate([[0], np.cumsum(parts)])
        which = np.repeat(np.arange(len(at)), n)
        tokens = every[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(at) < len(sets) else every
        part = ((tokens & np.uint64(0xFFFFFFFF)) * parts[which].astype(np.uint64)) >> np.uint64(32)
        # a part has 2^32 bits, so that unlike sets hardly ever agree in one by chance; only those toggled are held
        code = mix((tokens >> np.uint64(32)) | (part << np.uint64(32)) | (band[which].astype(np.uint64) << np.uint64(56)))
        place = first[which] + part.astype(np.int64)
        state = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(state, place, code)
        used = np.bincount(place, minlength=first[-1]) > 0
        owner = np.repeat(np.arange(len(at)), parts)
        empty = parts - np.bincount(owner, used, len(at)).astype(np.int64)
        short = empty >= parts - bands.apart[band]  # as many empty parts as the pigeonhole leaves: post them too
        keep = used | short[owner]
        index = np.arange(first[-1]) - first[owner]
        salt = mix((index.astype(np.uint64) << np.uint64(20)) + band[owner].astype(np.uint64) + np.uint64(1))
        states.append(mix(state + salt)[keep])
        owners.append(at[owner[keep]])
    return (np.concatenate(states), np.concatenate(owners)) if states else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bit_sketch(shingles: np.ndarray) -> bytes:
    """The parity sketch in at least as many bits as the set has elements (a power of two, 64 or more)."""
    bits = 1 << max(6, int(len(shingles) - 1).bit_length())
    toggled = np.bincount((shingles >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(toggled.astype(np.uint8)).tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch in fewer 64-bit words, which is the sketch that so many bits would have given."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, words), axis=0)


def near_enough(x: bytes, y: bytes, total: int, percent: int) -> bool:
    """False only if sets with these sketches, of `total` elements together, cannot link."""
    words = min(len(x), len(y)) // 8
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) * (100 + percent) <= (100 - percent) * total


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch (texts in column 1) in parts of a bounded number of documents and bytes."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float))
    first, held = 0, 0.0
    for k, n in enumerate(sizes):
        if k > first and (held + n > SLICE_BYTES or k - first >= SLICE):
            yield batch.slice(first, k - first)
            first, held = k, 0.0
        held += n
    if len(sizes) > first:
        yield batch.slice(first)


def _sets(docs: DataFrame, key: str, text: str, words: int, rows, schema: str) -> DataFrame:
    """rows(ids, sets) for the documents with an id, batch by batch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from rows(part.column(0).to_numpy(zero_copy_only=False), shingle_sets(texts(part.column(1)), words))

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(mapped, schema)


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns' rows packed by bucket."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    if len(cuts):
        parts = [[c[order[a:b]].tobytes() for a, b in zip(cuts, [*cuts[1:], len(order)])] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts], pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names)


def describe(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n, fingerprint, sketch): each document's number of shingles, a 128-bit digest of its set and its bit sketch."""

    def rows(ids, sets):
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([bit_sketch(s) for s in sets], pa.binary())], ["id", "n", "fingerprint", "sketch"])

    return _sets(docs, key, text, words, rows, "id long, n long, fingerprint binary, sketch binary")


def _runs(states: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The postings by state and id, and where each state's begin and how many they are."""
    order = np.lexsort((ids, states))
    states, ids = states[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]])) if len(states) else np.zeros(0, np.int64)
    return states, ids, first, np.diff([*first, len(states)])


def _pair_rows(ids: np.ndarray, hubs: np.ndarray, flags: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct (id, hub, flags), packed by a hash of the id, in the columns of postings."""
    other = ids != hubs
    pairs = np.unique(np.stack([ids[other], hubs[other], flags[other]], 1), axis=0)
    for batch in _dealt((mix(pairs[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), [pairs], ["bucket", "pairs"]):
        none = pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), none, none, batch.column(1)], _POSTED)


_POSTED = ["bucket", "states", "ids", "pairs"]
#: Of a pair: its state has more than two documents; both were met by the task that posted them; or by a state's task; there
#: the document stood for others of its slice.
CROWDED, LOCAL, WIDE, MARKED = 1, 2, 4, 8


def hub_pairs(docs: DataFrame, bands: Bands, buckets: int, key: str = "doc_id", text: str = "text", words: int = WORDS, hot_from: int = HOT) -> DataFrame:
    """(id, hub, crowded, local, wide, marked): each document with the smallest one of every posted state that it shares; crowded:
    if any such state has more than two documents.

    Postings travel packed, by bucket: 47 bits of a state, a mark, and the id. A state that `hot_from` or more documents of one
    slice share is pre-aggregated: they are paired with the slice's smallest (local), and only that one, marked, goes on
    to meet those of other slices (wide). So what one task gets of the most frequent state is an id for each slice.
    """
    buckets |= 1  # odd: the bits that make the bucket are not those that travel

    def post(ids, sets):
        states, owners = postings(sets, bands)
        states, own, first, n = _runs(states, ids[owners].astype(np.int64))
        hot = n >= hot_from
        sent = ~np.repeat(hot, n)
        sent[first[hot]] = True
        inside = np.repeat(hot, n)
        hubs = np.repeat(own[first], n)
        yield from _pair_rows(own[inside], hubs[inside], np.full(inside.sum(), CROWDED | LOCAL), buckets)
        marked = np.zeros(len(states), np.uint64)
        marked[first[hot]] = 1
        kept = ((states << np.uint64(1)) | marked)[sent]
        low = kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        own = own[sent]
        small = len(own) and int(own.max()) - int(own.min()) < 1 << 32
        base = own.min() if small else np.int64(0)
        for batch in _dealt(((states[sent] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), [low, (own - base).astype("<u4" if small else "<i8")], _POSTED[:3]):
            numbers = pa.array([base.tobytes() + x for x in batch.column(2).to_pylist()], pa.binary())  # what they count from goes before them
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers, pa.nulls(batch.num_rows, pa.binary())], _POSTED)

    def unpacked(states: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(states) // 6
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :6] = np.frombuffer(states, np.uint8).reshape(n, 6)
        own = np.frombuffer(ids, "<i8" if len(ids) == 8 + 8 * n else "<u4", offset=8).astype(np.int64)
        return whole.view("<u8").ravel(), own + np.frombuffer(ids, "<i8", 1)[0]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            pairs = batch.filter(batch.column(3).is_valid())
            if pairs.num_rows:
                yield pairs
            held += [unpacked(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if x is not None]
        if not held:
            return
        states, ids = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        marked = (states & np.uint64(1)).astype(bool)
        order = np.argsort(states >> np.uint64(1), kind="stable")
        states, ids, marked = states[order] >> np.uint64(1), ids[order], marked[order]
        same = np.concatenate([[False], states[1:] == states[:-1], [False]])
        met = same[1:] | same[:-1]  # alone in its state: nothing to say
        states, ids, marked = states[met], ids[met], marked[met]
        if len(states):
            first = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
            n = np.diff([*first, len(states)])
            crowd = (n > 2) | np.logical_or.reduceat(marked, first)
            yield from _pair_rows(ids, np.repeat(np.minimum.reduceat(ids, first), n), np.repeat(np.where(crowd, CROWDED | WIDE, WIDE), n) | np.where(marked, MARKED, 0), buckets)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, np.int64).reshape(-1, 3) for batch in batches for x in batch.column(3).to_pylist()]
        if not held:
            return
        pairs = np.unique(np.concatenate(held), axis=0)
        first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)))
        flags, pairs = np.bitwise_or.reduceat(pairs[:, 2], first), pairs[first]
        for at in range(0, len(pairs), 100_000):
            p, f = pairs[at : at + 100_000], flags[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), *(pa.array(f & x > 0) for x in (CROWDED, LOCAL, WIDE, MARKED))], ["id", "hub", "crowded", "local", "wide", "marked"])

    schema = "bucket int, states binary, ids binary, pairs binary"
    posted = _sets(docs, key, text, words, post, schema)
    met = posted.repartition(buckets, "bucket").mapInArrow(meet, schema)
    return met.select("bucket", "pairs").repartition(buckets, "bucket").select("bucket", F.lit(None).alias("s"), F.lit(None).alias("i"), "pairs").mapInArrow(once, "id long, hub long, crowded boolean, local boolean, wide boolean, marked boolean")


def _with_sets(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(id, set) of the documents in the pairs' columns a and b."""
    ids = settled(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << FILTER_BITS)).cast("int")
    table = np.zeros(1 << FILTER_BITS - 3, np.uint8).reshape(-1, 4096)
    parts = ids.select(F.shiftright(place("id"), 15).alias("part"), place("id").bitwiseAND(32767).alias("bit"))
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():  # 512 rows at most, however many ids
        table[r.part] = np.frombuffer(r.bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table.ravel())

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            kept = batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool))).select([0, 1])
            for part in _slices(kept):
                sets = shingle_sets(texts(part.column(1)), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), place(key).alias("place"))
    return rows.mapInArrow(pick, "id long, set binary").join(ids, "id", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `linked`: the exact decision on the whole sets."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["a", "b", "linked"])

    one = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return two.mapInArrow(decide, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked"))


def _screened(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, n_a, n_b, s_a, s_b) whose sketches are near enough, as (a, b)."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, s_a, s_b = (batch.column(k).to_pylist() for k in range(2, 6))
            ok = pa.array([near_enough(x, y, m + n, percent) for m, n, x, y in zip(n_a, n_b, s_a, s_b)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(screen, "a long, b long")


def _in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents of one hub but of different components whose sketches are near enough.

    members: (hub, id, component, n, sketch). Every hub's documents are dealt into blocks; a task has two blocks of one hub.
    """
    few, most = BLOCK
    large = settled(members.groupBy("hub").agg(F.count("*").alias("size")).where(F.col("size") > few))  # the others are one block
    n_blocks = F.greatest(F.ceil(F.col("size") / most), F.least(F.lit(32), F.ceil(F.col("size") / few))).cast("int")
    rows = members.join(large.select("hub", n_blocks.alias("blocks")), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "id", "component", "n", "sketch")

    def near(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        ids, own, size = (table.column(c).to_numpy() for c in ("id", "component", "n"))
        held = table.column("sketch").to_pylist()
        words = np.array([len(x) // 8 for x in held])
        out = [np.zeros((0, 2), np.int64)]
        for w in np.unique(words):  # partners' sketches are as long or twice as long
            at = np.flatnonzero((words == w) | (words == 2 * w))
            sketch = np.stack([folded(held[k], w) for k in at])
            stop = np.searchsorted(size[at], size[at] * 100 // percent, "right")
            for k in np.flatnonzero(words[at] == w):
                other = slice(k + 1, stop[k])
                apart = np.bitwise_count(sketch[other] ^ sketch[k]).sum(1, dtype=np.int64)
                ok = (apart * (100 + percent) <= (100 - percent) * (size[at[k]] + size[at[other]])) & (own[at[other]] != own[at[k]])
                if ok.any():
                    out.append(np.stack([np.full(ok.sum(), ids[at[k]]), ids[at[other]][ok]], 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pairs.max(1), "b": pairs.min(1)})

    return dealt.groupBy("hub", "i", "j").applyInArrow(near, "a long, b long").distinct()


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, hot_from: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(described, linked): describe(docs), and pairs (a, b) of ids that link, enough to connect all that any link does."""
    described = settled(describe(docs, key, text, words))
    total = described.agg(F.max("n"), F.sum("n")).first()
    bands = Bands(percent, total[0] or 0)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total[1] or 0) // POSTINGS)
    found = settled(hub_pairs(docs, bands, buckets, key, text, words, hot_from))
    info = lambda c: described.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("fingerprint").alias(f"f_{c}"), F.col("sketch").alias(f"s_{c}"))
    known = found.select(F.col("id").alias("a"), F.col("hub").alias("b")).join(info("a"), "a").join(info("b"), "b")
    known = known.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").withColumn("equal", F.expr("f_a = f_b AND n_a = n_b"))
    open_pairs = settled(_screened(known.where("NOT equal"), percent).distinct())
    verified = _verify(open_pairs, _with_sets(open_pairs, docs, key, text, words), percent)
    linked = settled(known.where("equal").select("a", "b").unionByName(verified.where("linked").select("a", "b")).distinct())
    # hubs with a failed document among more than two: their documents meet again
    unfit = found.where("crowded").select("id", "hub", "local").join(linked.select(F.col("a").alias("id"), F.col("b").alias("hub")), ["id", "hub"], "left_anti")
    mixed = settled(unfit.groupBy("hub").agg(F.max("local").alias("local")))
    if mixed.isEmpty():
        return described, linked
    # where a slice's documents fail, so do those of the states for which its hub stood
    over = found.where("marked").join(mixed.where("local").select(F.col("hub").alias("id")), "id", "left_semi").select("hub")
    mixed = settled(mixed.select("hub").unionByName(over).distinct())
    parts = settled(components(linked, "a", "b")).withColumnRenamed("node", "id")
    own = described.select("id", "fingerprint", "n").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    direct = found.where("crowded").join(mixed, "hub", "left_semi")
    asked = direct.where("marked").select(F.col("id").alias("hub")).distinct()
    # exact copies answer through one of them
    inside = found.where("local").select("hub", "id").join(asked, "hub", "left_semi").join(own, "id")
    inside = settled(inside.groupBy("hub", "fingerprint", "component", "n").agg(F.min("id").alias("id")))
    # only hubs that have several components are taken apart; which ones is seen from each slice's first and last component
    ends = (F.min("component").alias("x"), F.max("component").alias("y"))
    met = direct.select("hub", "id").unionByName(mixed.select("hub", F.col("hub").alias("id"))).join(own.select("id", "component"), "id")
    slices = direct.where("marked").select("hub", "id").join(inside.groupBy(F.col("hub").alias("id")).agg(*ends), "id").select("hub", "x", "y")
    spans = met.select("hub", F.col("component").alias("x"), F.col("component").alias("y")).unionByName(slices)
    several = settled(spans.groupBy("hub").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("hub"))
    direct = settled(direct.join(several, "hub", "left_semi").select("hub", "id", "marked"))
    # of one state are sets from the least that is posted in a band to the band's last: percent ** 2 apart at most
    tops = direct.where("marked").join(described.select(F.col("id").alias("hub"), F.col("n").alias("top_n")), "hub").select(F.col("hub").alias("top"), "top_n", F.col("id").alias("hub"))
    below = tops.join(inside, "hub").where(f"10000 * least(n, top_n) >= {percent * percent} * greatest(n, top_n)").select(F.col("top").alias("hub"), "fingerprint", "component", "id")
    members = direct.select("hub", "id").unionByName(several.select("hub", F.col("hub").alias("id"))).join(own, "id").select("hub", "fingerprint", "component", "id")
    members = members.unionByName(below).groupBy("hub", "fingerprint", "component").agg(F.min("id").alias("id"))
    members = settled(members.drop("fingerprint").join(described.select("id", "n", "sketch"), "id"))
    more = settled(_in_blocks(members, percent))
    more = _verify(more, _with_sets(more, docs, key, text, words), percent).where("linked").select("a", "b")
    return described, settled(linked.unionByName(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, hot_from: int = HOT) -> DataFrame:
    """(key, n_shingles, component_id), a row for each row of docs."""
    described, linked = links(docs, key, text, percent, words, hot_from)
    labels = settled(components(linked, "a", "b"))
    rows = described.join(labels, described.id == labels.node, "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    lost = docs.where(F.col(key).isNull()).select(F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return rows.unionByName(lost)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """docs, same columns: of each component the rows of its smallest id stay; rows without an id stay too."""
    _, linked = links(docs, key, text, percent, words)
    extra = components(linked, "a", "b").where("node <> component").select(F.col("node").alias("__node"))
    return docs.join(extra, F.col(key).cast("long") == F.col("__node"), "left_anti")
