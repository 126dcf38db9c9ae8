"""Token counts from flat unindexed token files.

A flat file is token ids of a fixed width, end to end; a reserved id ends each document. Nothing else says where a
document lies. Files are scanned in blocks, by range: each block yields the places of its separators (one vectorised
comparison), a prefix scan over the blocks' summaries (separators so far, last separator so far) stitches documents that
cross block boundaries, and each block then emits the documents that end in it.

Contract. A file's last document needs no separator if it has tokens. Two adjacent separators enclose a document of no
tokens. An empty file has no documents. A size that is no multiple of the width is an error. The scan holds one block
at a time; a file may be larger than any worker.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import create, filesystem, open_ranges, scratch, settled

#: Tokens that a task reads at once.
BLOCK = 4_000_000
#: Pieces are split by this pattern before the rank file's merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks: bytes):
    """The encoding of a rank file's content, without special tokens."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


def write_token_files(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text", eod: int = 50256, width: str = "<u2", folder: str | None = None) -> DataFrame:
    """Writes each partition's documents as one flat file in the shared folder; returns (file, ordinal, key) of each.

    The returned table is written once; a retried task writes a file under another name, and only files of tasks that
    ended well are named in it. Null text has no tokens.
    """
    folder = folder or scratch(docs.sparkSession, "tokens")
    with open(rank_file, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks.value)
        out, n, uri = None, 0, f"{folder}/{uuid.uuid4().hex}.bin"
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or create(uri)
            for value in batch.column(1).to_pylist():
                ids = encoding.encode_ordinary(value or "")
                out.write(np.array([*ids, eod], width).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([uri] * batch.num_rows), pa.array(range(n, n + batch.num_rows), pa.int64()), batch.column(0)], ["file", "ordinal", key])
            n += batch.num_rows
        if out:
            out.close()

    kind = docs.schema[key].dataType.simpleString()
    return settled(docs.select(key, text).mapInArrow(write, f"file string, ordinal long, `{key}` {kind}"))


def scan_token_files(spark: SparkSession, files: DataFrame, eod: int = 50256, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, first, n_tokens) of every document in the files (column `file`: URIs)."""
    size = np.dtype(width).itemsize

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = filesystem(uri)
                total = store.get_file_info(path).size
                if total % size:
                    raise ValueError(f"{uri}: its size is no multiple of {size}")
                starts = list(range(0, total // size, block))
                ends = [min(s + block, total // size) for s in starts]
                last = [e == total // size for e in ends]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(starts), pa.string()), pa.array(range(len(starts)), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(last, pa.bool_())], ["file", "block", "start", "stop", "is_last"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_ranges(row["file"]) as f:
                    f.seek(row["start"] * size)
                    tokens = np.frombuffer(f.read((row["stop"] - row["start"]) * size), width)
                at = np.flatnonzero(tokens == eod) + row["start"]
                if row["is_last"] and len(tokens) and tokens[-1] != eod:  # the last document has no separator
                    at = np.append(at, row["stop"])
                yield pa.RecordBatch.from_arrays([*(pa.array([row[c]]) for c in ("file", "block")), pa.array([at.tolist()], pa.list_(pa.int64()))], ["file", "block", "at"])

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = files.select("file").distinct().mapInArrow(blocks, "file string, block long, start long, stop long, is_last boolean")
    found = settled(ranges.repartition(n, "file", "block").mapInArrow(find, "file string, block long, at array<long>"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = found.select(
        "file",
        "block",
        F.coalesce(F.sum(F.size("at")).over(order), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.when(F.size("at") > 0, F.element_at("at", -1))).over(order), F.lit(-1)).alias("last"),
    )
    each = found.where(F.size("at") > 0).join(before, ["file", "block"]).select("file", "seen", "last", "at", F.posexplode("at").alias("k", "stop"))
    first = F.when(F.col("k") == 0, F.col("last")).otherwise(F.element_at("at", F.greatest(F.col("k"), F.lit(1)))) + 1
    return each.select("file", (F.col("seen") + F.col("k")).alias("ordinal"), first.alias("first"), (F.col("stop") - first).alias("n_tokens"))


def count_tokens(docs: DataFrame, rank_file: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, n_tokens): the documents written as flat token files and counted from them."""
    written = write_token_files(docs, rank_file, key, text)
    found = scan_token_files(docs.sparkSession, written, block=block)
    return written.join(found, ["file", "ordinal"]).select(key, "n_tokens")
