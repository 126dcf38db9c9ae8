"""TAR and ZIP archives, read by ranges: an index of the members first, then the bytes of those that are asked for.

The index is a table. One task walks one archive's headers (TAR) or reads its directory (ZIP, ZIP64 too), by range reads
that skip the members' bytes. The members asked for, after any filter on the index, are dealt by stretches of `SPLIT`
bytes of their archive, so one large archive is read by many tasks, and each task opens the archive only at its members.
Compressed TARs have no places to jump to: one task streams each, and its members leave it one by one.

Archives lie in any store that pyarrow knows (local, HDFS, S3, GCS); their paths are listed by Spark.

Contract. Members come with their archive, name, offset (of the bytes of a TAR member, of the local header in a ZIP;
null in a compressed TAR), stored and full size and method. Folders, links and devices are left out. Equal names in one
archive are members each. An archive that is damaged or neither TAR nor ZIP is an error that names it, unless
broken="skip"; a ZIP member whose check sum differs always is. Empty archives have no members.
"""

from __future__ import annotations

import bz2
import io
import json
import lzma
import os
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, settled, ship

#: Bytes of an archive that one task reads, and bytes of members in one batch.
SPLIT, BATCH = 64 << 20, 8 << 20
#: Bytes of a member that are read, or decompressed, at once.
PIECE = 1 << 20
INDEX = "archive string, member string, offset long, stored long, size long, method string, crc long"
MEMBERS = "archive string, member string, size long, content binary"


def open_ranges(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _create(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length) of the files below the paths or matching them; nothing of them is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return found.select("path", "length")


def _kind(file: pa.NativeFile) -> str:
    head = file.read(6)
    file.seek(0)
    if head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
        return "stream"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x06\x06"):
        return "zip"
    size = file.size()
    file.seek(max(0, size - 65_557))
    tail = file.read()
    file.seek(0)
    return "zip" if b"PK\x05\x06" in tail and zipfile.is_zipfile(file) else "tar"


_METHODS = {zipfile.ZIP_STORED: "stored", zipfile.ZIP_DEFLATED: "deflate", zipfile.ZIP_BZIP2: "bzip2", zipfile.ZIP_LZMA: "lzma"}


def _entries(uri: str) -> Iterator[tuple]:
    with open_ranges(uri) as file:
        kind = _kind(file)
        file.seek(0)
        if kind == "zip":
            with zipfile.ZipFile(file) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        method = "encrypted" if m.flag_bits & 1 else _METHODS.get(m.compress_type, str(m.compress_type))
                        yield uri, m.filename, m.header_offset, m.compress_size, m.file_size, method, m.CRC
        elif kind == "tar":
            if file.size():
                with tarfile.open(fileobj=file, mode="r:") as t:
                    for m in t:
                        if m.isfile():
                            method = "sparse" if m.issparse() else "stored"
                            yield uri, m.name, m.offset_data, m.size, m.size, method, None
                        t.members = []  # a header that was read is not kept
        else:
            with tarfile.open(fileobj=file, mode="r|*", bufsize=PIECE) as t:
                for m in t:
                    if m.isfile():
                        yield uri, m.name, None, None, m.size, "stream", None
                    t.members = []


def index(spark: SparkSession, *paths: str, broken: str = "error") -> DataFrame:
    """The members of all archives below the paths, without their bytes."""
    ship(spark)
    names = [c.split()[0] for c in INDEX.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held = []
                try:
                    for entry in _entries(uri):
                        held.append(entry)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held = []
                except (tarfile.TarError, zipfile.BadZipFile, EOFError, zlib.error, OSError, lzma.LZMAError) as e:
                    if broken != "skip":
                        raise ValueError(f"{uri} cannot be read: {e}") from e
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    files = list_files(spark, *paths)
    # one archive for a task, wherever Spark's listing puts them
    return settled(files.repartition(max(1, files.count()), "path").select("path").mapInArrow(walk, INDEX))


def _inflated(pieces: Iterator[bytes], method: str) -> Iterator[bytes]:
    if method == "stored":
        yield from pieces
        return
    made: Callable = {"deflate": lambda: zlib.decompressobj(-15), "bzip2": bz2.BZ2Decompressor}[method]
    inflate = made()
    for piece in pieces:
        yield inflate.decompress(piece)
    if method == "deflate":
        yield inflate.flush()


def _zip_pieces(file: pa.NativeFile, offset: int, stored: int, method: str) -> Iterator[bytes]:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(offset + 30 + name + extra)

    def raw() -> Iterator[bytes]:
        left = stored
        while left and (piece := file.read(min(PIECE, left))):
            left -= len(piece)
            yield piece
        if left:
            raise ValueError(f"the member at {offset} is cut off")

    if method == "lzma":  # a header of its own before the stream
        whole = b"".join(raw())
        size = struct.unpack("<H", whole[2:4])[0]
        filters = [lzma._decode_filter_properties(lzma.FILTER_LZMA1, whole[4 : 4 + size])]
        yield lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(whole[4 + size :])
    elif method in ("stored", "deflate", "bzip2"):
        yield from _inflated(raw(), method)
    else:
        raise ValueError(f"the member at {offset} is compressed by an unknown method ({method})")


def member_pieces(file: pa.NativeFile, member: str, offset: int, stored: int, method: str, crc: int | None) -> Iterator[bytes]:
    """A member's bytes in pieces; a ZIP member's check sum is held against them at the end."""
    if method == "sparse":
        raise ValueError(f"{member} is a sparse TAR member")
    if crc is None:  # TAR
        file.seek(offset)
        while stored:
            piece = file.read(min(PIECE, stored))
            if not piece:
                raise ValueError(f"{member} is cut off")
            stored -= len(piece)
            yield piece
        return
    sum_ = 0
    for piece in _zip_pieces(file, offset, stored, method):
        sum_ = zlib.crc32(piece, sum_)
        yield piece
    if sum_ != crc:
        raise ValueError(f"{member}: the check sum differs")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["archive", "member", "size", "content"])

    for row in rows:
        held.append(row)
        size += len(row[3])
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def read_members(members: DataFrame, split: int = SPLIT, most: int | None = None) -> DataFrame:
    """(archive, member, size, content) of the members of an index, or what a filter left of it. A member over `most`
    bytes, where that is given, is an error."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def checked(name: str, size: int) -> None:
        if most is not None and size > most:
            raise ValueError(f"{name} has {size} bytes, more than {most}")

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            uri, file = None, None
            for batch in batches:
                for archive, member, offset, stored, size, method, crc in zip(*(c.to_pylist() for c in batch.columns)):
                    checked(member, size)
                    if archive != uri:
                        if file is not None:
                            file.close()
                        uri, file = archive, open_ranges(archive)
                    yield archive, member, size, b"".join(member_pieces(file, member, offset, stored, method, crc))
            if file is not None:
                file.close()

        yield from _batches(rows())

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for archive, names in zip(*(c.to_pylist() for c in batch.columns)):
                    wanted = set(names)
                    with open_ranges(archive) as file, tarfile.open(fileobj=file, mode="r|*", bufsize=PIECE) as t:
                        for m in t:
                            if m.isfile() and m.name in wanted:
                                checked(m.name, m.size)
                                yield archive, m.name, m.size, t.extractfile(m).read()
                            t.members = []

        yield from _batches(rows())

    names = [c.split()[0] for c in INDEX.split(", ")]
    held = members.where("method <> 'stream'").withColumn("__at", F.expr(f"offset div {split}"))
    dealt = held.repartition(parts, "archive", "__at").sortWithinPartitions("archive", "offset").select(*names)
    found = dealt.mapInArrow(ranged, MEMBERS)
    # of a compressed TAR the names that are wanted go to the one task that streams it
    wanted = members.where("method = 'stream'").groupBy("archive").agg(F.collect_set("member").alias("names"))
    return found.unionByName(wanted.mapInArrow(streamed, MEMBERS))


def json_items(pieces: Iterator[bytes]) -> Iterator[tuple[str, str]]:
    """(key, value as JSON) of one JSON object that comes in pieces; no more than one value and a piece is held."""
    decode, text = json.JSONDecoder(), ""
    reader = io.TextIOWrapper(_Pieces(pieces), encoding="utf-8-sig", newline="")
    ended = False

    def more() -> bool:
        nonlocal text, ended
        new = reader.read(PIECE)
        ended = not new
        text += new
        return not ended

    def skip(signs: str) -> str:
        """The next sign that is neither white space nor one of the signs."""
        nonlocal text
        while True:
            text = text.lstrip(" \t\r\n" + signs)
            if text or not more():
                return text[:1]

    if skip("") != "{":
        raise ValueError("a JSON object is needed")
    text = text[1:]
    while (sign := skip(",")) != "}":
        if sign != '"':
            raise ValueError("the JSON object is cut off" if not sign else f"{sign!r} where a key belongs")
        found = []
        for signs in ("", ":"):
            skip(signs)
            while True:
                try:
                    value, end = decode.raw_decode(text)
                    if end < len(text) or ended:  # a number may go on in the next piece
                        break
                except json.JSONDecodeError:
                    if ended:
                        raise ValueError("the JSON object is cut off") from None
                # twice as much before the next try, so long values are not decoded over and over
                want = 2 * len(text)
                while len(text) < want and more():
                    pass
                if not text:
                    raise ValueError("the JSON object is cut off")
            found.append((value, text[:end]))
            text = text[end:]
        yield found[0][0], found[1][1]


class _Pieces(io.RawIOBase):
    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.held = piece
        n = min(len(into), len(self.held))
        into[:n] = self.held[:n]
        self.held = self.held[n:]
        return n


def read_json_items(members: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(archive, member, key, value) of members that are one JSON object each, such as a knowledge base of pages by
    address: a task streams a member, with one value in memory. wanted: a table whose first column names the keys to keep."""
    kinds = "archive string, member string, key string, value string"

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, member, offset, stored, _, method, crc in zip(*(c.to_pylist() for c in batch.columns)):
                held, size = [], 0
                with open_ranges(archive) as file:
                    for key, value in json_items(member_pieces(file, member, offset, stored, method, crc)):
                        held.append((archive, member, key, value))
                        size += len(value)
                        if size >= BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["archive", "member", "key", "value"])
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["archive", "member", "key", "value"])

    names = [c.split()[0] for c in INDEX.split(", ")]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = members.where("method <> 'stream'").repartition(parts, "archive", "offset").select(*names).mapInArrow(items, kinds)
    return found if wanted is None else found.join(wanted.select(F.col(wanted.columns[0]).alias("key")).distinct(), "key", "left_semi").select("archive", "member", "key", "value")


def _written(rows: DataFrame, name: str, ending: str, write: Callable[[Iterator[pa.RecordBatch], pa.NativeFile], int]) -> DataFrame:
    """(archive, members) of what successful tasks wrote: each attempt writes a file of its own."""
    folder = scratch(rows.sparkSession, name)
    ship(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/{uuid.uuid4().hex}.{ending}"
        with _create(uri) as out:
            n = write(batches, out)
        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], ["archive", "members"])

    return settled(rows.mapInArrow(task, "archive string, members long"))


def write_tar(rows: DataFrame, member: str, content: str) -> DataFrame:
    """A TAR for each partition; the table of their paths. Null contents are empty members."""

    def write(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> int:
        n = 0
        for batch in batches:
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                info = tarfile.TarInfo(name)
                info.size = len(data or b"")
                out.write(info.tobuf(tarfile.PAX_FORMAT))
                out.write(data or b"")
                out.write(bytes(-info.size % 512))
                n += 1
        out.write(bytes(1024))
        return n

    return _written(rows.select(F.col(member), F.col(content).cast("binary")), "tar", "tar", write)


def write_zip(rows: DataFrame, member: str, content: str, deflated: bool = True) -> DataFrame:
    """A ZIP for each partition; the table of their paths. Null contents are empty members."""

    def write(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> int:
        n = 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED) as z:
            for batch in batches:
                for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                    z.writestr(name, data or b"")
                    n += 1
        return n

    return _written(rows.select(F.col(member), F.col(content).cast("binary")), "zip", "zip", write)


def write_json_zip(rows: DataFrame, key: str, value: str, member: str = "items.json") -> DataFrame:
    """A ZIP for each partition with one member, a JSON object of the rows (value: JSON text)."""

    def write(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> int:
        n = 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as f:
            f.write(b"{")
            for batch in batches:
                for k, v in zip(*(c.to_pylist() for c in batch.columns)):
                    f.write(b"," if n else b"")
                    f.write(f"{json.dumps(k)}:{v or 'null'}".encode())
                    n += 1
            f.write(b"}")
        return n

    return _written(rows.select(F.col(key), F.col(value)), "zip", "zip", write)


def paths_of(written: DataFrame) -> list[str]:
    """The archives' paths: one for each task that wrote."""
    return [r.archive for r in written.select("archive").collect()]


def read_archive_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".json",), most: int | None = None) -> DataFrame:
    """(archive, member, size, content) of the members whose names end so."""
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.endswith("member", F.lit(s))
    return read_members(index(spark, path).where(wanted), most=most)


def paired_members(members: DataFrame) -> DataFrame:
    """Images with the JSON record of the same stem beside them."""
    stem = members.withColumn("stem", F.regexp_replace("member", r"\.[^.]*$", "")).withColumn("suffix", F.regexp_extract("member", r"\.([^.]*)$", 1))
    records = stem.where("suffix = 'json'").select("archive", "stem", F.col("content").cast("string").alias("record"))
    return stem.where("suffix <> 'json'").join(records, ["archive", "stem"])
