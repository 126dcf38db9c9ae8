"""Alignment of two tokenizers' tokens by a transducer over dangling suffixes.

Both tokenizers spell the same bytes. The tokens are read side by side, always from the side that is behind: the
transducer's state is the side that leads and the bytes by which it does. A token that is read meets the leader's last
token, which is one link; it shortens the residual, or takes the lead with what it has over, or leaves nothing, which
closes a group. Transitions are remembered by residual and token, and over them, from the start of a group, by its
tokens so far (up to `DEEP` of them), so that a common group costs one look for each of its tokens. What a worker remembers
is bounded by `REMEMBERED` and begins anew beyond that.

Corpus counts. A pair's count is the number of rows in which it is linked: each row's distinct pairs are written once
and counted by Spark, with partial sums. The counted pairs, of which there are no more than the two vocabularies allow,
go to the rows again in slices of at most `SLICE` pairs, each a broadcast of known size.

Contract. Side A is a byte-level BPE file in JSON form and reads a space and the text; side B is a piece model with byte
fallback that puts the space before the text itself. Strings of special tokens are plain text. Null and empty texts, and
texts that a side does not give back byte by byte, have no tokens: zeros, and an empty `groups`. Every row counts as a
document, repeated ones too. Ties for the highest count all count as best. Very long texts are read whole. An empty
table gives no rows. Columns other than key and text are left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import scratch, settled, ship

#: Tokens of a group up to which its path is remembered.
DEEP = 24
#: Groups, and states on the way to them, that a worker remembers.
REMEMBERED = 300_000
#: Characters of text that are aligned at once.
CHARACTERS = 1 << 20
#: Counted pairs in one broadcast: 17 bytes each.
SLICE = 4_000_000
#: The pattern by which byte-level BPE splits a text before the merges (fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the piece models' sign for a space.
SPACE_SIGN = "▁"


class ByteLevel:
    """Side A. Where the file's merges stand in the order of their ids, as rank files have it, the faster library does."""

    def __init__(self, text: str):
        model = json.loads(text)
        inner, split = model["model"], model.get("pre_tokenizer") or {}
        if inner["type"] != "BPE" or split.get("type") != "ByteLevel":
            raise ValueError("a byte-level BPE model is needed")
        value = {s: b for b, s in enumerate(byte_symbols())}
        added = {t["id"]: t["content"] for t in model.get("added_tokens", [])}
        self.bytes = {i: bytes(value[c] for c in name) for name, i in inner["vocab"].items() if i not in added}
        self.bytes |= {i: name.encode() for i, name in added.items()}
        self.size = max(self.bytes) + 1
        pairs = (m if isinstance(m, list) else m.split(" ") for m in inner["merges"])
        learnt = [inner["vocab"][a + b] for a, b in pairs]
        plain = {i: b for i, b in self.bytes.items() if i not in added}
        ordered = sorted(plain) == list(range(256 + len(learnt))) and learnt == list(range(256, 256 + len(learnt)))
        simple = not model.get("normalizer") and not split.get("add_prefix_space") and split.get("use_regex", True) and not inner.get("ignore_merges") and not inner.get("dropout")
        if ordered and simple:
            fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in plain.items()}, special_tokens={})
            self.encode = fast.encode_ordinary
        else:
            slow = Tokenizer.from_str(text)
            slow.no_truncation()
            slow.no_padding()
            slow.encode_special_tokens = True
            self.encode = lambda x: slow.encode(x, add_special_tokens=False).ids


class Pieces:
    """Side B."""

    def __init__(self, model: bytes):
        held = SentencePieceProcessor(model_proto=model)
        self.encode = held.encode
        self.size = held.vocab_size()
        names = map(held.id_to_piece, range(self.size))
        self.bytes = {i: bytes([int(p[3:5], 16)]) if held.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(names)}


class _Path(dict):
    """A group's tokens so far, none of them closing it: the next token leads to the next path or to a closed group."""

    __slots__ = ("all", "lead", "rest", "a", "b", "links")

    def __init__(self, all_: "Transducer", lead: bool, rest: bytes, a: tuple, b: tuple, links: tuple):
        self.all, self.lead, self.rest, self.a, self.b, self.links = all_, lead, rest, a, b, links

    def __missing__(self, token: int):
        if len(self.a) + len(self.b) >= DEEP:
            return None
        step, a, b = self.all.step(self.lead, self.rest, token), self.a, self.b
        links = (*self.links, (a[-1], token) if self.lead else (token, b[-1]))
        a, b = (a, (*b, token)) if self.lead else ((*a, token), b)
        self[token] = found = self.all.group(a, b, links) if step is None else _Path(self.all, *step, a, b, links)
        self.all.paths += 1
        return found


class _Starts(dict):
    """The paths of one token of side A."""

    def __init__(self, all_: "Transducer"):
        self.all = all_

    def __missing__(self, token: int) -> _Path:
        self[token] = found = _Path(self.all, True, self.all.a[token], (token,), (), ())
        return found


class Transducer:
    """Aligns token ids whose bytes, joined, are the same. a, b: the bytes of each side's ids."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes], b_size: int):
        self.a, self.b, self.b_size = a, b, b_size
        self.forget()

    def forget(self) -> None:
        self.steps: dict[tuple[bool, bytes, int], tuple[bool, bytes] | None] = {}
        self.starts, self.paths = _Starts(self), 0
        self.names: list[str] = []
        self.codes: list[int] = []
        self.ends = [0]

    def step(self, lead: bool, rest: bytes, token: int) -> tuple[bool, bytes] | None:
        """Whether A leads (lead) by the bytes `rest`; the other side's token is read: the same of the next state, None if closed."""
        key = (lead, rest, token)
        found = self.steps.get(key, 0)
        if found == 0:
            over = len(own := (self.b if lead else self.a)[token]) - len(rest)
            found = self.steps[key] = None if not over else (not lead, own[len(rest) :]) if over > 0 else (lead, rest[len(own) :])
        return found

    def group(self, a, b, links) -> int:
        """The number of a closed group from now on."""
        self.names.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.codes += [x * self.b_size + y for x, y in links]
        self.ends.append(len(self.codes))
        return len(self.names) - 1

    def _long(self, path: _Path, token: int, next_a, next_b) -> int:
        """A group of more than DEEP tokens, to its end."""
        lead, rest, a, b, links = path.lead, path.rest, [*path.a], [*path.b], [*path.links]
        while True:
            links.append((a[-1], token) if lead else (token, b[-1]))
            (b if lead else a).append(token)
            step = self.step(lead, rest, token)
            if step is None:
                return self.group(a, b, links)
            lead, rest = step
            token = next_b() if lead else next_a()

    def align(self, a: list[int], b: list[int]) -> list[int]:
        """The numbers of the groups, in order."""
        out: list[int] = []
        add, starts, rest = out.append, self.starts, iter(a)
        next_a, next_b = rest.__next__, iter(b).__next__
        for token in rest:
            path = starts[token][next_b()]
            while path.__class__ is not int:
                token = next_b() if path.lead else next_a()
                path, before = path[token], path
                if path is None:
                    path = self._long(before, token, next_a, next_b)
            add(path)
        return out


class Aligner:
    """Both tokenizers and their transducer, in a worker process."""

    def __init__(self, a_model: str, b_model: bytes):
        self.a, self.b = ByteLevel(a_model), Pieces(b_model)
        self.transducer = Transducer(self.a.bytes, self.b.bytes, self.b.size)

    def groups(self, text: str | None) -> tuple[int, int, list[int]]:
        """Numbers of tokens, and the groups."""
        if not text:
            return 0, 0, []
        a, b, whole = self.a.encode(" " + text), self.b.encode(text), b" " + text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return 0, 0, []
        return len(a), len(b), self.transducer.align(a, b)

    def rows(self, texts: list[str | None], digest: bool) -> tuple:
        """Columns n_a, n_b, n_groups, n_links, groups, and as lists by row: distinct pairs' codes and how often each is linked."""
        own = self.transducer
        if own.paths + len(own.steps) + len(own.codes) // 8 > REMEMBERED:
            own.forget()
        n_a, n_b, found = zip(*map(self.groups, texts))
        groups = [";".join(map(own.names.__getitem__, g)) for g in found]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        n = np.array([len(g) for g in found], np.int64)
        flat = np.fromiter((x for g in found for x in g), np.int64, n.sum())
        ends = np.array(own.ends, np.int64)
        counts = ends[flat + 1] - ends[flat]
        at = np.arange(counts.sum()) + np.repeat(ends[flat] - np.cumsum(counts) + counts, counts)
        row, codes = np.repeat(np.repeat(np.arange(len(texts)), n), counts), np.array(own.codes, np.int64)[at]
        order = np.lexsort((codes, row))
        row, codes = row[order], codes[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])]))
        offsets = np.searchsorted(row[first], np.arange(len(texts) + 1)).astype(np.int32)
        n_links = np.bincount(row, minlength=len(texts))
        return n_a, n_b, n, n_links, groups, (offsets, codes[first]), (offsets, np.diff(first, append=len(row)))


_held: dict[str, Aligner] = {}


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, groups, pairs, times), a row for each row.

    groups: `a1,a2|b1;a3|b2,b3`, the decimal ids of each group, or with digest the SHA-256 of that. pairs: the distinct
    linked pairs as a * (size of B's vocabulary) + b; times: how many links each has in the row.
    """
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        models = (f.read(), g.read())
    sides = ByteLevel(models[0]).size, Pieces(models[1]).size
    sent, name = sc.broadcast(models), f"{sc.applicationId}:{a_path}:{b_path}"
    code = ("int", pa.int32()) if sides[0] * sides[1] < 1 << 31 else ("long", pa.int64())

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _held:
            _held.clear()
            _held[name] = Aligner(*sent.value)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHARACTERS):
                    size += len(texts[end] or "")
                    end += 1
                *plain, groups, pairs, times = _held[name].rows(texts[at:end], digest)
                lists = [pa.ListArray.from_arrays(x[0], pa.array(x[1], kind)) for x, kind in ((pairs, code[1]), (times, pa.int32()))]
                columns = [batch.column(0).slice(at, end - at), *(pa.array(x, pa.int64()) for x in plain), pa.array(groups), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])
                at = end

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(aligned, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<{code[0]}>, times array<int>").withColumnRenamed("key", key)


def count_pairs(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, n, best): in how many rows a pair is linked, and whether that is the most of all pairs of its A id."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counted = settled(counted.withColumn("a", F.expr(f"pair div {b_size}")))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return settled(counted.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best")))


def with_counts(aligned: DataFrame, counted: DataFrame, most: int = SLICE) -> DataFrame:
    """aligned with n_best (links whose count is their A id's highest) and count_sum (counts over the links), without its pairs."""
    spark = aligned.sparkSession
    slices = max(1, -(-counted.count() // most))
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(slices):
        known = counted.where(F.pmod(F.xxhash64("a"), F.lit(slices)) == k).orderBy("pair").select("pair", "n", "best").toArrow()
        sent = spark.sparkContext.broadcast([known.column(c).to_numpy() for c in ("pair", "n", "best")])
        rows = rows.mapInArrow(_looked_up(sent, rows.columns), rows.schema)
        if k + 1 < slices:
            rows = settled(rows)
    return rows.select(*names, "n_best", "count_sum")


def _looked_up(sent, names: list[str]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            own, times = columns["pairs"], columns["times"].flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            codes = own.flatten().to_numpy()
            at = np.searchsorted(pairs, codes)
            there = pairs[np.minimum(at, max(0, len(pairs) - 1))] == codes if len(pairs) else np.zeros(len(codes), bool)
            at, times = at[there], times * there
            for name, weight in (("n_best", best), ("count_sum", n)):
                each = times.copy()
                each[there] *= weight[at]
                sums = np.diff(np.concatenate([[0], np.cumsum(each)])[ends])
                columns[name] = pa.array(columns[name].to_numpy() + sums)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return found


def report(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", most: int = SLICE) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "alignment")
    with open(b_path, "rb") as f:
        b_size = Pieces(f.read()).size
    align(docs, a_path, b_path, key, text, digest=True).write.parquet(folder)
    held = spark.read.parquet(folder)
    counted = with_counts(held, count_pairs(held, b_size), most)
    return counted.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
