"""BPE encoding and decoding with a contiguous rank array.

A piece's part boundaries and the ranks of its adjacent pairs lie in two small lists. The lowest rank (leftmost on
ties) is found by scanning, its right boundary is deleted, and the two neighbouring ranks are refreshed, until no pair
has a rank. Pieces over `LONG` symbols take the same merges from a heap instead, so that one endless word does not cost
its length squared.

The vocabulary file is the public JSON form of a BPE model: NFC, white space dropped, lower case, pieces split by the
file's own pattern, byte symbols, a word-end suffix; ids decode to the joined vocabulary entries. White-space-delimited
chunks encode independently of each other, so each worker keeps a bounded table of chunks it has met.

Contract. Null text counts as empty and gives no ids. The strings of special tokens in a text become their ids, as the
file's `added_tokens` say. Repeated rows are each encoded. Extra columns pass. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import ship

#: Symbols of a piece up to which the rank array is scanned.
LONG = 256
#: Chunks in each of the two generations that a worker remembers.
REMEMBERED = 200_000
#: Capital sigma lower-cases to the same letter wherever it stands.
SIGMA = ("\u03a3", "\u03c3")
#: What the file's pattern counts as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    def __init__(self, model: dict):
        inner = model["model"]
        if inner["type"] != "BPE" or inner.get("byte_fallback") or inner.get("dropout"):
            raise ValueError("a plain BPE model is needed")
        self.vocabulary: dict[str, int] = inner["vocab"]
        self.suffix = inner.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in inner["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.decimals = {p: str(i) for p, i in self.vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.names = {v: k for k, v in (self.vocabulary | self.special).items()}
        self.named = {str(v): k for v, k in self.names.items()}
        self.symbols = byte_symbols()
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE))
        self.space = re.compile(f"[{SPACE}]+")
        self.odd_space = re.compile("[\x1c-\x1f]")
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, tuple[int, str]] = {}
        self.older = self.known

    def merge(self, parts: list[str]) -> list[str]:
        """The parts after all merges."""
        if len(parts) > LONG:
            return self._merge_long(parts)
        get = self.ranks.get
        parts = list(parts)
        ranks = list(map(get, zip(parts, parts[1:]), repeat(_NONE)))
        while ranks and (low := min(ranks)) != _NONE:
            k = ranks.index(low)
            parts[k] = both = parts[k] + parts[k + 1]
            del ranks[k], parts[k + 1]
            if k:
                ranks[k - 1] = get((parts[k - 1], both), _NONE)
            if k < len(ranks):
                ranks[k] = get((both, parts[k + 1]), _NONE)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        get, n = self.ranks.get, len(parts)
        parts: list[str | None] = list(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, left, right = heapq.heappop(heap)
            j = after[k]
            if parts[k] != left or j >= n or parts[j] != right:
                continue
            parts[k], parts[j] = left + right, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for a in (before[k], k):
                b = after[a] if a >= 0 else n
                if b < n and (r := get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _chunk(self, chunk: str) -> tuple[int, str]:
        """Number of ids, and the ids joined by spaces."""
        if out := self.older.get(chunk):
            self.known[chunk] = out
            return out
        names: list[str] = []
        whole = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace(*SIGMA).lower()
        for piece in [whole] if whole.isalpha() and whole.isascii() else self.pieces.findall(whole):
            parts = list(piece) if piece.isascii() and piece.isprintable() else [self.symbols[b] for b in piece.encode("utf-8", "replace")]
            parts[-1] += self.suffix
            names += self.merge(parts)
        ids = list(map(self.decimals.get, names))
        if None in ids:  # symbols that the vocabulary lacks give no ids
            ids = [i for i in ids if i is not None]
        out = (len(ids), " ".join(ids))
        if len(chunk) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[chunk] = out
        return out

    def _plain(self, text: str) -> list[tuple[int, str]]:
        chunks = self.space.split(text) if self.odd_space.search(text) else text.split()
        known = self.known
        return [known.get(c) or self._chunk(c) for c in chunks if c]

    def encode(self, text: str) -> tuple[int, str]:
        """Number of ids, and the ids as decimals joined by spaces."""
        if self.special_at and "<" in text and self.special_at.search(text):
            found, at = [], 0
            for m in self.special_at.finditer(text):
                found += [*self._plain(text[at : m.start()]), (1, str(self.special[m[0]]))]
                at = m.end()
            found += self._plain(text[at:])
        else:
            found = self._plain(text)
        found = [x for x in found if x[0]]
        return sum(x[0] for x in found), " ".join([x[1] for x in found])

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The ids' vocabulary entries joined by spaces; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def decode_decimals(self, ids: str) -> str:
        """decode() of ids written as decimals joined by spaces."""
        found = list(map(self.named.get, ids.split()))
        return " ".join(found if None not in found else [x for x in found if x is not None])


_loaded: dict[str, Bpe] = {}


def _held(key: str, model) -> Bpe:
    """A worker process keeps its tokenizer, and the chunks that it has met, from task to task."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(json.loads(model.value))
    return _loaded[key]


def _mapped(docs: DataFrame, model_path: str, text: str, added: list[T.StructField], row) -> DataFrame:
    ship(docs.sparkSession)
    with open(model_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    at, names = docs.columns.index(text), [*docs.columns, *(f.name for f in added)]
    schema = T.StructType([*docs.schema.fields, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    key = f"{docs.sparkSession.sparkContext.applicationId}:{model_path}"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _held(key, model)
        for batch in batches:
            rows = [row(bpe, t or "") for t in batch.column(at).to_pylist()]
            if rows:
                new = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names)

    return docs.mapInArrow(encoded, schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the columns `ids` (array of int) and, if named, `decoded` (the ids decoded again)."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def row(bpe: Bpe, value: str) -> tuple:
        found = bpe.ids(value)
        return (found, bpe.decode(found)) if decoded else (found,)

    return _mapped(docs, model_path, text, added, row)


_DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def _digests(n: int, ids: str, decoded: str) -> tuple[int, str, str]:
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def digest(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, and SHA-256 of its ids and of the text that they decode to."""

    def row(bpe: Bpe, value: str) -> tuple:
        n, ids = bpe.encode(value)
        return _digests(n, ids, bpe.decode_decimals(ids))

    return _mapped(docs.select(key, text), model_path, text, _DIGEST, row).drop(text)


def tokenise(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs, all columns, with `ids` (array of int) and the columns of digest(); columns of these names are replaced."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *_DIGEST]

    def row(bpe: Bpe, value: str) -> tuple:
        n, found = bpe.encode(value)
        return (np.array(found.split(), np.int32), *_digests(n, found, bpe.decode_decimals(found)))

    return _mapped(docs.drop(*(f.name for f in added)), model_path, text, added, row)
