"""Token-true windows: texts cut by a vocabulary's tokens, with the characters that each window covers.

The tokenizer is a parameter: the path of a rank file (`.tiktoken`), a JSON file of the tokenizers library, or a
sentencepiece model (`.model`). Its bytes are broadcast; a worker builds it once. Encoding sees whole texts, so windows are
those of the ids, however a text is long. A window's text is its ids decoded, bytes of a character that a border cuts
replaced, trimmed; its place is the characters that begin in it.

Contract. Null texts count as empty and have no windows (0 tokens). Strings of special tokens are plain text. Windows
follow each other every size - overlap tokens until the text's last token begins one. Extra columns of docs pass;
repeated rows are each cut. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship

#: The pattern by which rank files of byte-level BPE split a text before the merges (fixed value of the public format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Windows in one batch.
BATCH = 1000
SIZE, OVERLAP = 768, 64


class Vocabulary:
    """encode(text) -> ids; pieces(text, ids) -> the bytes that each id stands for; decode(ids) -> text."""

    def __init__(self, name: str, data: bytes, pattern: str = PATTERN):
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
            held = tiktoken.Encoding("windows", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode: Callable = held.encode_ordinary
            self.decode: Callable = lambda ids: held.decode(ids, errors="replace")
            self.ends: Callable = lambda text, ids: _character_ends(text, [len(held.decode_single_token_bytes(i)) for i in ids])
        elif name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            held = SentencePieceProcessor(model_proto=data)
            self.encode, self.decode = held.encode, held.decode
            size = lambda i: 1 if held.is_byte(i) else len(held.id_to_piece(i).replace("\u2581", " ").encode())
            # the model puts a space before the text; places are those of a model that leaves texts as they are otherwise
            self.ends = lambda text, ids: _character_ends(text, [size(i) - (k == 0) for k, i in enumerate(ids)])
        else:
            from tokenizers import Tokenizer

            held = Tokenizer.from_str(data.decode())
            held.no_truncation()
            held.no_padding()
            held.encode_special_tokens = True
            self.encode = lambda text: held.encode(text, add_special_tokens=False).ids
            self.decode = lambda ids: held.decode(ids, skip_special_tokens=False)
            self.ends = lambda text, ids: [b for _, b in held.encode(text, add_special_tokens=False).offsets]


def _character_ends(text: str, lengths: list[int]) -> list[int]:
    """For each token the number of characters that begin before its end."""
    data = np.frombuffer(text.encode(), np.uint8)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return begun[np.minimum(np.cumsum(lengths), len(data))].tolist()


_held: dict[str, Vocabulary] = {}


def _mapped(docs: DataFrame, path: str, text: str, added: list[T.StructField], rows: Callable[[Vocabulary, str], Iterator[tuple]]) -> DataFrame:
    """docs with the added columns, a row for each that rows() gives."""
    sc = docs.sparkSession.sparkContext
    ship(docs.sparkSession)
    with open(path, "rb") as f:
        sent = sc.broadcast(f.read())
    key, at, names = f"{sc.applicationId}:{path}", docs.columns.index(text), [*docs.columns, *(f.name for f in added)]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
            _held[key] = Vocabulary(path, sent.value)

        def batch(source: pa.RecordBatch, of: list[int], found: list[tuple]) -> pa.RecordBatch:
            kept = source.take(pa.array(of, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names)

        for source in batches:
            of, found = [], []
            for i, value in enumerate(source.column(at).to_pylist()):
                for row in rows(_held[key], value or ""):
                    of.append(i)
                    found.append(row)
                    if len(found) == BATCH:
                        yield batch(source, of, found)
                        of, found = [], []
            if found:
                yield batch(source, of, found)

    return docs.mapInArrow(mapped, T.StructType([*docs.schema.fields, *added]))


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of each text's tokens: what a prompt's length is measured in."""
    return _mapped(docs, path, text, [T.StructField(into, T.LongType())], lambda v, t: iter([(len(v.encode(t)) if t else 0,)]))


def within_tokens(docs: DataFrame, path: str, most: int, text: str = "text") -> DataFrame:
    """The rows whose text has at most so many tokens."""
    return count_tokens(docs, path, text, "__n").where(f"__n <= {most}").drop("__n")


def token_windows(docs: DataFrame, path: str, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """docs, its text replaced by the windows': (..., chunk_order_index, tokens, start, end), start and end in characters."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    added = [T.StructField("chunk_order_index", T.IntegerType()), T.StructField("tokens", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("__window", T.StringType())]

    def windows(v: Vocabulary, value: str) -> Iterator[tuple]:
        ids = v.encode(value) if value else []
        ends = [0, *v.ends(value, ids)] if ids else [0]
        for k, a in enumerate(range(0, len(ids), size - overlap)):
            b = min(a + size, len(ids))
            yield k, b - a, ends[a], ends[b], v.decode(ids[a:b]).strip()

    cut = _mapped(docs, path, text, added, windows)
    return cut.withColumn(text, cut["__window"]).drop("__window")
