"""GraphML, read by byte ranges and element by element.

A file is cut into ranges of `SPLIT` bytes. A task reads its range from the first element that begins in it to the end of
the last one that does, and parses one node, edge or key at a time, so neither a tree nor a whole file is ever held. A
bare `<` stands in no XML text or attribute, so an element's beginning is recognised anywhere, except inside comments and
CDATA sections: files in which these hold whole node or edge tags are read with split=None, one task each.

Two passes: one looks for keys alone, and their names go to each file's ranges; the other parses nodes and edges, some at
once, and names their attributes as it goes, so what is parsed is not dealt again.

Contract. UTF-8 (other encodings with split=None). Keys may stand before or behind what uses them; a key that is not
declared keeps its id as its name. Elements may have a prefix. Broken elements and what follows the break in a cut-off
file are left out; an empty or broken file gives what is whole in it. Repeated nodes and edges are rows each.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .archives import list_files, open_ranges

NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
#: Bytes of a range, of one read, and of a file's head, in which its root stands.
SPLIT, PIECE, HEAD = 32 << 20, 1 << 20, 1 << 16
#: Bytes, and elements, that are parsed at once; rows of a batch.
BLOCK, TOGETHER, ROWS = 1 << 18, 256, 10_000
NODES, EDGES, KEYS = "node", "edge", "key"
_KEY = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?key)(?=[\s/>])")
_BEGIN = re.compile(rb"<((?:[A-Za-z_][\w.-]*:)?(?:node|edge|key))(?=[\s/>])")
#: A tag as a whole; signs of tags inside quotes do not end it.
_TAG = re.compile(rb"<(?:!--.*?--|!\[CDATA\[.*?\]\]|[^<>\"'!][^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>", re.DOTALL)
_ROOT = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?graphml\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")


def _element_end(data: bytes, at: int, name: bytes) -> int | None:
    """The end of the element that begins at `at`; None if it is not there yet."""
    depth, close = 0, b"</" + name
    if (tag := _TAG.match(data, at)) is not None:  # mostly nothing of its name is inside, so the next closing tag is its own
        if tag[0].endswith(b"/>"):
            return tag.end()
        shut = data.find(close, tag.end())
        end = data.find(b">", shut) if shut >= 0 else -1
        if end >= 0 and not data[shut + len(close) : end].strip(b" \t\r\n") and data.find(b"<" + name, tag.end(), shut) < 0 and data.find(b"<!", tag.end(), shut) < 0:
            return end + 1
    while (tag := _TAG.search(data, at)) is not None:
        text = tag[0]
        if text.startswith(b"<" + name) and text[len(name) + 1 : len(name) + 2] in (b" ", b"\t", b"\r", b"\n", b"/", b">"):
            depth += not text.endswith(b"/>")
        elif text.startswith(close) and text[len(close) : len(close) + 1] in (b" ", b"\t", b"\r", b"\n", b">"):
            depth -= 1
        at = tag.end()
        if depth <= 0:
            return at
    return None


def elements(file: pa.NativeFile, start: int, end: int, begin: re.Pattern = _BEGIN) -> Iterator[bytes]:
    """The elements that begin from start up to end."""
    file.seek(start)
    data, base, at, ended = b"", start, 0, False  # base: where data lies in the file
    while True:
        found = begin.search(data, at)
        if found is None:
            keep = data.rfind(b"<", max(at, len(data) - 256))  # a beginning that is cut off
            keep = len(data) if keep < 0 else keep
            if ended or base + keep >= end:
                return
            # up to the range's end, and some for an element that lies across it
            piece = file.read(min(PIECE, max(end - base - len(data), 0) + 4096))
            data, base, at, ended = data[keep:] + piece, base + keep, 0, not piece
            continue
        if base + found.start() >= end:
            return
        stop = _element_end(data, found.start(), found[1])
        while stop is None:
            piece = file.read(max(min(PIECE, 4096), len(data)))
            if not piece:
                return  # cut off
            data += piece
            stop = _element_end(data, found.start(), found[1])
        yield data[found.start() : stop]
        at = found.end() if begin.search(data, found.end(), stop) else stop  # nested elements count for themselves


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _blocks(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if len(held) == TOGETHER or size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _parsed(texts: list[bytes], wrap: bytes) -> list[ET.Element]:
    """Elements parsed as one text; where that breaks, those that are whole, one by one."""
    try:
        found = list(ET.fromstring(wrap + b"".join(texts) + b"</g>"))
        if len(found) == len(texts):
            return found
    except ET.ParseError:
        pass
    found = []
    for text in texts:
        try:
            found.append(ET.fromstring(wrap + text + b"</g>")[0])
        except (ET.ParseError, IndexError):
            continue
    return found


def _row(x: ET.Element, names: dict[str, str]) -> tuple[str, str | None, str | None, dict[str, str]]:
    """(kind, a, b, data): a key's id and name, a node's id, an edge's ends; attributes by name."""
    kind = _local(x.tag)
    if kind == KEYS:
        return kind, x.get("id"), x.get("attr.name"), {}
    data = {d.get("key"): d.text or "" for d in x if _local(d.tag) == "data" and d.get("key") is not None}
    return kind, x.get("id" if kind == NODES else "source"), x.get("target"), {names.get(k, k): v for k, v in data.items()}


def _rows(uri: str, start: int, end: int, kinds: tuple[str, ...], names: dict[str, str]) -> Iterator[tuple]:
    begin, wanted = (_KEY if kinds == (KEYS,) else _BEGIN), re.compile(rb"<(?:[^\s/>:]*:)?(?:" + "|".join(kinds).encode() + rb")[\s/>]")
    with open_ranges(uri) as file:
        root = _ROOT.search(file.read(HEAD))
        wrap = b"<g" + (root[1].rstrip(b"/") if root else b"") + b">"
        for texts in _blocks(text for text in elements(file, start, end, begin) if wanted.match(text)):
            for x in _parsed(texts, wrap):
                yield _row(x, names)


def _whole(uri: str, kinds: tuple[str, ...], names: dict[str, str]) -> Iterator[tuple]:
    """The same of a file that cannot be cut, event by event."""
    with open_ranges(uri) as file:
        try:
            for _, x in ET.iterparse(file):
                kind = _local(x.tag)
                if kind in kinds:
                    yield _row(x, names)
                if kind in (NODES, EDGES):
                    x.clear()
        except ET.ParseError:
            return


def _batch(rows: list[tuple], uri: str) -> pa.RecordBatch:
    kinds, a, b, data = zip(*rows)
    names, values, offsets = [], [], [0]
    for x in data:
        names += x
        values += x.values()
        offsets.append(len(names))
    maps = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), *(pa.array(c, pa.string()) for c in (kinds, a, b)), maps], ["path", "kind", "a", "b", "data"])


def _scan(ranges: DataFrame, split: int | None, *kinds: str) -> DataFrame:
    """(path, kind, a, b, data) of the elements in ranges (path, start, length, names)."""
    parts = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, length, names in zip(*(c.to_pylist() for c in batch.columns)):
                known = dict(names or [])
                rows = _rows(uri, start, min(length, start + split), kinds, known) if split else _whole(uri, kinds, known)
                while held := list(islice(rows, ROWS)):
                    yield _batch(held, uri)

    return ranges.repartition(parts, "path", "start").mapInArrow(parse, "path string, kind string, a string, b string, data map<string,string>")


def read_elements(spark: SparkSession, *paths: str, split: int | None = SPLIT, kinds: tuple[str, ...] = (NODES, EDGES)) -> DataFrame:
    """(kind, source, target, weight, data) of GraphML files, read once for both kinds: a node's id is its source, and its
    target and weight are null; attributes are maps by name."""
    ship(spark)
    files = list_files(spark, *paths).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))) if split else F.lit(0).cast("long")
    ranges = files.select("path", starts.alias("start"), "length")
    keys = _scan(ranges.withColumn("names", F.lit(None).cast("map<string,string>")), split, KEYS)
    keys = keys.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("a", F.coalesce("b", "a").alias("b")))).alias("names"))
    found = _scan(ranges.join(keys, "path", "left").select("path", "start", "length", "names"), split, *kinds)

    def strip(c: str) -> Column:
        return F.btrim(F.col(c), F.lit('"'))

    edge = F.col("kind") == EDGES
    weight = F.coalesce(F.try_element_at("data", F.lit("weight")).try_cast("double"), F.lit(0.0))
    return found.select("kind", strip("a").alias("source"), F.when(edge, strip("b")).alias("target"), F.when(edge, weight).alias("weight"), "data")


def read_graphml(spark: SparkSession, *paths: str, split: int | None = SPLIT) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files, their attributes as maps by name. Each of them is a reading; `read_elements` gives both in one."""
    nodes, edges = (read_elements(spark, *paths, split=split, kinds=(k,)) for k in (NODES, EDGES))
    return nodes.select(F.col("source").alias("node"), "data"), edges.select("source", "target", "weight", "data")


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines (kind, value) of a graph: every node and edge as an object, keys sorted, to be written as text."""
    first = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("data", F.col("node").alias("id"))).alias("value"))
    return first.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("data", "source", "target", "weight")).alias("value")))
