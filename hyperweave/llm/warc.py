"""WARC records in ZIP-packaged archives, written and read by range.

An archive is a ZIP file whose members are stored, not deflated: `archive/*.warc.gz`, in which each record is a gzip
member of its own (or `archive/*.warc`, plain), and `indexes/*`, CDXJ lines that say where records lie. The reader finds
the end record, follows the ZIP64 locator where it is there, walks the central directory, maps stored members to absolute
offsets and range-reads single records; nothing is extracted. Data members that no index names are scanned from their
beginning, by bounded reads. The writer closes an archive and begins another when its data has `ROLL` bytes.

Contract. Of records with equal payloads of at least `least` bytes, the one with the smallest key is a response and the
others revisit it, without payload. Shorter ones are all responses. Null payload counts as empty. Rows with a null key
take part as responses. Repeated keys: equal payloads under the smallest key are all responses. An empty table writes
no archive and gives no rows. Extra columns are ignored. Records that others wrote: the payload of an HTTP response is
what follows its header; its digest is computed anew and compared with the record's, if that is SHA-256 or SHA-1; the key
is the record's id, and null where the key's type cannot hold it. A revisit of unknown length has a null length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import create, filesystem, open_ranges, scratch, settled

#: Payload bytes from which equal payloads are written once.
LEAST = 100
#: Bytes of neighbouring records that one range read takes together.
RANGE = 4 << 20
#: Bytes that a scan inflates at once.
STEP = 1 << 16
#: Data bytes from which an archive is closed.
ROLL = 1 << 30
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_BIG = 0xFFFFFFFF


class StoredZip:
    """A sequential writer of stored members. Sizes follow each member, so nothing is sought; offsets and sizes are
    kept in ZIP64 fields where they need them, or always, if asked."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64, self.open = out, 0, [], zip64, None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.open = {"name": name.encode(), "at": self.at, "crc": 0, "size": 0}
        raw = self.open["name"]
        # version 4.5, a data descriptor follows, stored; the ZIP64 field says that the descriptor has 8-byte sizes
        self._put(struct.pack("<4s5H3L2H", _LOCAL, 45, 0x0808, 0, 0, 33, 0, _BIG, _BIG, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.open["crc"] = zlib.crc32(data, self.open["crc"])
        self.open["size"] += len(data)
        self._put(data)

    def end(self) -> None:
        m = self.open
        self._put(struct.pack("<4sL2Q", b"PK\x07\x08", m["crc"], m["size"], m["size"]))
        self.members.append(m)
        self.open = None

    def close(self) -> None:
        start = self.at
        for m in self.members:
            wide = self.zip64 or max(m["size"], m["at"]) >= _BIG
            extra = struct.pack("<2H3Q", 1, 24, m["size"], m["size"], m["at"]) if wide else b""
            size, at = (_BIG, _BIG) if wide else (m["size"], m["at"])
            self._put(struct.pack("<4s6H3L5H2L", _CENTRAL, 45, 45, 0x0808, 0, 0, 33, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, at) + m["name"] + extra)
        n, length = len(self.members), self.at - start
        wide = self.zip64 or max(start, length) >= _BIG or n >= 0xFFFF
        if wide:
            here = self.at
            self._put(struct.pack("<4sQ2H2L4Q", _END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sLQL", _LOCATOR, 0, here, 1))
        self._put(struct.pack("<4s4H2LH", _END, 0, 0, *((0xFFFF,) * 2 if wide else (n, n)), _BIG if wide else length, _BIG if wide else start, 0))


def read_directory(f, size: int) -> dict[str, dict]:
    """Members of a ZIP by name: method, size, stored (bytes in the file) and start (of the data), by range reads."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail = at(max(0, size - 65557), min(size, 65557))
    k = tail.rfind(_END)
    while k >= 0 and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail):
        k = tail.rfind(_END, 0, k)
    if k < 0:
        raise ValueError("no ZIP end record")
    n, length, start = struct.unpack_from("<H2L", tail, k + 10)
    end = max(0, size - 65557) + k
    if end >= 20 and (locator := at(end - 20, 20))[:4] == _LOCATOR:
        record = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end record where its locator points")
        n, length, start = struct.unpack_from("<3Q", record, 32)
    found, directory, p = {}, at(start, length), 0
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<2H", directory, p + 8)
        stored, full, names, extras, notes = struct.unpack_from("<2L3H", directory, p + 20)
        (offset,) = struct.unpack_from("<L", directory, p + 42)
        name = directory[p + 46 : p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        e, stop = p + 46 + names, p + 46 + names + extras
        while e + 4 <= stop:
            tag, n_bytes = struct.unpack_from("<2H", directory, e)
            if tag == 1:  # only the fields that did not fit stand here, in this order
                wide = iter(struct.unpack_from(f"<{n_bytes // 8}Q", directory, e + 4))
                full = next(wide) if full == _BIG else full
                stored = next(wide) if stored == _BIG else stored
                offset = next(wide) if offset == _BIG else offset
            e += 4 + n_bytes
        head = at(offset, 30)
        if head[:4] != _LOCAL:
            raise ValueError("no local header where the directory points")
        found[name] = {"method": method, "size": full, "stored": stored, "start": offset + 30 + sum(struct.unpack_from("<2H", head, 26))}
        p = stop + notes
    return found


def record(key: object, uri: str | None, payload: bytes, digest: str, refers_to: object, length: int) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its length and digest."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:row:{'' if key is None else key}>", f"WARC-Target-URI: {json.dumps(uri or '')[1:-1]}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{refers_to}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return named, rest[: int(named["content-length"])]


def _urn(value: str | None) -> str | None:
    """What a record's id names: the key of rows written here, else the whole id."""
    value = (value or "").removeprefix("<").removesuffix(">")
    return value.removeprefix("urn:row:") or None


def _payload(head: dict[str, str], block: bytes) -> bytes:
    if head.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _row(head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """(key, target, payload_bytes, payload_digest, record_type, refers_to, payload) of a record."""
    kind, (name, _, digest) = head["warc-type"], head.get("warc-payload-digest", "").partition(":")
    target = head.get("warc-target-uri", "").removeprefix("<").removesuffix(">")
    if head.get("warc-record-id", "").startswith("<urn:row:"):  # targets written here are escaped
        target = json.loads(f'"{target}"')
    if kind == "revisit":
        length = head.get("x-payload-length")
        return _urn(head.get("warc-record-id")), target, int(length) if length else None, digest, kind, _urn(head.get("warc-refers-to")), None
    payload = _payload(head, block)
    found = hashlib.sha256(payload)
    known = {"sha256": found, "sha1": hashlib.sha1(payload)}.get(name.lower())
    if known and digest.lower() != known.hexdigest() and digest.upper().rstrip("=") != base64.b32encode(known.digest()).decode().rstrip("="):
        raise ValueError("a payload does not match its digest")
    return _urn(head.get("warc-record-id")), target, len(payload), found.hexdigest(), kind, None, payload if with_payload else None


def scan_records(f, start: int, size: int, packed: bool) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a stored data member, one after the other, by reads of at most RANGE bytes."""
    f.seek(start)
    left, held, at = size, b"", 0

    def more() -> bool:
        nonlocal left, held, at
        data = f.read(min(RANGE, left))
        left -= len(data)
        held, at = held[at:] + data, 0
        return bool(data)

    def ended() -> bool:
        return at >= len(held) and not more()

    if packed:
        while not ended():
            inflate, out = zlib.decompressobj(31), []
            while not inflate.eof:
                if ended():
                    raise ValueError("a record ends early")
                piece = held[at : at + STEP]
                out.append(inflate.decompress(piece))
                at += len(piece) - len(inflate.unused_data)
            yield parse(b"".join(out))
        return
    while not ended():
        while (stop := held.find(b"\r\n\r\n", at)) < 0 and more():
            pass
        found = [x for x in held[at:stop].lower().split(b"\r\n") if x.startswith(b"content-length:")] if stop >= 0 else []
        if not found:
            raise ValueError("a record ends early")
        length = stop - at + 4 + int(found[0].partition(b":")[2])
        while len(held) - at < length + 4 and more():
            pass
        yield parse(held[at : at + length])
        at += length + 4


def index_lines(data: bytes) -> list[tuple[str, int, int]]:
    """(file name, offset, length) of each line of a CDXJ index that says so."""
    out = []
    for line in data.decode("utf-8", "replace").splitlines():
        entry = line[line.find("{") :] if "{" in line else ""
        try:
            found = json.loads(entry)
            out.append((found["filename"], int(found["offset"]), int(found["length"])))
        except (ValueError, KeyError, TypeError):
            continue  # a header line, or one that places nothing
    return out


def write_archives(pages: DataFrame, key: str, payload: str, uri: str | None = None, least: int = LEAST, folder: str | None = None, zip64: bool = False, level: int = 1, roll: int = ROLL) -> DataFrame:
    """Writes each partition's rows as archives in the shared folder; returns (archive, n_records), written once.

    Which payloads repeat is found from digests alone (key, digest), pre-aggregated before the shuffle; only revisits'
    targets are joined back to the rows, by their key.
    """
    folder = folder or scratch(pages.sparkSession, "archives")
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    digests = pages.where(F.col(key).isNotNull() & (F.octet_length(body) >= least)).select(F.col(key).alias("k"), F.unhex(F.sha2(body, 256)).alias("d"))
    firsts = settled(digests.groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    revisits = digests.join(firsts, "d").where("k <> first").select(F.col("k").alias("__k"), F.col("first").alias("__first"), F.col("d").alias("__d")).distinct()
    rows = pages.select(F.col(key).alias("k"), (F.col(uri) if uri else F.lit(None)).cast("string").alias("uri"), body.alias("body"))
    rows = rows.withColumn("d", F.when(F.octet_length("body") >= least, F.unhex(F.sha2("body", 256))))
    joined = rows.join(revisits, (rows.k == F.col("__k")) & (rows.d == F.col("__d")), "left").select("k", "uri", "body", "__first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, index = None, []

        def closed() -> pa.RecordBatch:
            archive.end()
            archive.begin(INDEX)
            archive.write("".join(sorted(index)).encode())
            archive.end()
            archive.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], ["archive", "n_records"])

        for batch in batches:
            for k, target, text, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, index = f"{folder}/{uuid.uuid4().hex}.wacz", []
                    out = create(name)
                    archive = StoredZip(out, zip64)
                    archive.begin(DATA)
                data = text.encode()
                digest = hashlib.sha256(data).hexdigest()
                packed = gzip.compress(record(k, target, data, digest, first, len(data)), level, mtime=0)
                place = {"url": target or "", "digest": f"sha256:{digest}", "filename": DATA.rpartition("/")[2], "offset": str(archive.open["size"]), "length": str(len(packed))}
                index.append(f"{'' if k is None else k} 20240101000000 {json.dumps(place)}\n")
                archive.write(packed)
                if archive.open["size"] >= roll:
                    yield closed()
                    out = None
        if out:
            yield closed()

    return settled(joined.mapInArrow(write, "archive string, n_records long"))


def read_archives(spark: SparkSession, archives: DataFrame, key_type: str = "long", with_payload: bool = False, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """One row per record of the archives (column `archive`: URIs): key, target, payload_bytes, payload_digest,
    record_type, refers_to, and the payload if asked (null for revisits). `kinds` of records are read.

    First each archive's directory and indexes are read, and the records that they place are grouped to ranges of about
    `RANGE` bytes; a data member that no index names is one range, to be scanned. Then the ranges, dealt to all tasks,
    are read and parsed.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = filesystem(name)
                rows = []
                with store.open_input_file(path) as f:
                    members = read_directory(f, f.size())
                    data = {n: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
                    if any(m["method"] for m in data.values()):
                        raise ValueError(f"{name}: its data members are not stored")
                    placed: dict[str, list] = {n: [] for n in data}
                    for n, m in members.items():
                        if n.startswith("indexes/") and m["size"]:
                            f.seek(m["start"])
                            raw = f.read(m["stored"])
                            raw = zlib.decompress(raw, -15) if m["method"] else raw
                            for file, offset, length in index_lines(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                                if f"archive/{file}" in placed:
                                    placed[f"archive/{file}"].append((offset, length))
                for n, found in placed.items():
                    start, packed, held = data[n]["start"], n.endswith(".gz"), []
                    if not found and data[n]["size"]:
                        rows.append((name, start, [data[n]["size"]], packed, True))
                    for offset, length in sorted(set(found)):
                        if held and (offset != held[0] + sum(held[1:]) or offset + length - held[0] > RANGE):
                            rows.append((name, start + held[0], held[1:], packed, False))
                            held = []
                        held = held or [offset]
                        held.append(length)
                    if held:
                        rows.append((name, start + held[0], held[1:], packed, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_()))], ["archive", "start", "lengths", "packed", "whole"])

    def read(row: dict) -> Iterator[tuple[dict[str, str], bytes]]:
        with open_ranges(row["archive"]) as f:
            if row["whole"]:
                yield from scan_records(f, row["start"], row["lengths"][0], row["packed"])
                return
            f.seek(row["start"])
            data, at = memoryview(f.read(sum(row["lengths"]))), 0
            for n in row["lengths"]:
                yield parse(gzip.decompress(data[at : at + n]) if row["packed"] else bytes(data[at : at + n]))
                at += n

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "target", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for head, block in read(row):
                    if head["warc-type"] in kinds:
                        rows.append(_row(head, block, with_payload))
                        size += 1 + (len(block) if with_payload else 0)
                    if size >= RANGE or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    planned = archives.select("archive").mapInArrow(ranges, "archive string, start long, lengths array<long>, packed boolean, whole boolean")
    found = planned.repartition(n, "archive", "start").mapInArrow(records, "key string, target string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    found = found.withColumns({c: F.col(c).try_cast(key_type) for c in ("key", "refers_to")})
    return found if with_payload else found.drop("payload")
