"""Sources and sinks: JSON stores, GraphML, CSV, archives, splits and versions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .archives import paired_members, read_archive_members  # noqa: F401
from .graphml import NAMESPACE, read_graphml  # noqa: F401


def read_json_store(spark: SparkSession, path: str, value: str = "map<string,string>") -> DataFrame:
    """(id, value) of a file that is one JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with their keys sorted."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a string; quoted fields may hold line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, header: list[str]) -> None:
    """Columns in the order of the source's header, others after them; missing ones are empty."""
    known = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in header]
    df.select(*known, *[c for c in df.columns if c not in header]).write.mode("overwrite").csv(path, header=True, escape='"')


def read_splits(spark: SparkSession, paths: dict[str, str], required: tuple[str, ...] = ("train", "test"), limit: int | None = None) -> DataFrame:
    """Parquet splits as one table in the order train, validation, test, others; limit counts over all."""
    lost = [s for s in required if s not in paths]
    if lost:
        raise ValueError(f"missing splits: {', '.join(lost)}")
    order = {"train": 0, "dev": 1, "val": 1, "validation": 1, "test": 2}
    parts = [spark.read.parquet(p).withColumn("split", F.lit(s)).withColumn("split_order", F.lit(order.get(s, 3))) for s, p in sorted(paths.items(), key=lambda x: (order.get(x[0], 3), x[0]))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out if limit is None else out.orderBy("split_order", *[c for c in ("index", "data_id") if c in out.columns]).limit(limit)


def prompts_within(df: DataFrame, prompt: Column, most: int) -> DataFrame:
    """Rows whose prompt has at most so many white-space tokens."""
    return df.where(F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != "")) <= most)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes: (node, data), edges: (source, target, weight, data), data maps of attributes. Every part file is a whole
    document with a header, its attributes' keys and its own nodes and edges; read_graphml reads them all back. Characters
    that XML cannot hold become U+FFFD."""
    ship(nodes.sparkSession)
    null, none = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    rows = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), null.alias("b"), F.coalesce("data", none).alias("data"))
    plain = F.map_filter(F.coalesce("data", none), lambda k, v: k != "weight")
    weighed = F.map_concat(plain, F.create_map(F.lit("weight"), F.coalesce(F.col("weight").cast("string"), F.lit("0.0"))))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), weighed.alias("data")))
    held = F.map_filter("data", lambda _, v: v.isNotNull())
    held = F.when(F.size(held) > 1, F.map_from_entries(F.array_sort(F.map_entries(held)))).otherwise(held)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        def escaped(x: pa.Array, *pairs: tuple[str, str]) -> pa.Array:
            x = pc.replace_substring_regex(x, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "\ufffd")
            # the parser turns bare carriage returns into line feeds, so they go as references
            for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), *pairs):
                x = pc.replace_substring(x, sign, name)
            return x

        def joined(*parts: pa.Array | str) -> pa.Array:
            return pc.binary_join_element_wise(*parts, "")

        def attribute(x: pa.Array) -> pa.Array:
            return escaped(x, ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"))

        keys: dict[tuple[str, str], str] = {}
        yield pa.RecordBatch.from_arrays([pa.array([f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="{NAMESPACE}"><graph edgedefault="undirected">'])], ["value"])
        for batch in batches:
            for kind in ("node", "edge"):
                part = batch.filter(pc.equal(batch.column(0), kind))
                if not part.num_rows:
                    continue
                if any(part.column(k).null_count for k in ((1,) if kind == "node" else (1, 2))):
                    raise ValueError(f"{kind} without a name")  # a joined line would be null and be lost
                data = part.column(3)
                at, names = data.offsets, data.keys.dictionary_encode()
                ids = pa.array([keys.setdefault((kind, n), f"d{len(keys)}") for n in names.dictionary.to_pylist()], pa.string())
                each = joined('<data key="', ids.take(names.indices), '">', escaped(data.items), "</data>")
                inner = pc.binary_join(pa.ListArray.from_arrays(at, each), "")
                ends = (attribute(part.column(k)) for k in (1, 2))
                first = joined('<node id="', next(ends)) if kind == "node" else joined('<edge source="', next(ends), '" target="', next(ends))
                yield pa.RecordBatch.from_arrays([joined(first, '">', inner, f"</{kind}>")], ["value"])
        # the reader looks keys up by id, so they may stand after the graph that uses them
        named = attribute(pa.array([n for _, n in keys], pa.string())).to_pylist()
        named = [f'<key id="{i}" for="{kind}" attr.name="{n}" attr.type="string"/>' for ((kind, _), i), n in zip(keys.items(), named)]
        yield pa.RecordBatch.from_arrays([pa.array(["</graph>", *named, "</graphml>"], pa.string())], ["value"])

    rows.withColumn("data", held).mapInArrow(documents, "value string").write.mode("overwrite").text(path)


def write_version(df: DataFrame, table: str, version: int) -> str:
    """Writes a new version beside the old ones and returns its path; readers move on when they are told."""
    path = f"{table}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def synthetic_splits(spark: SparkSession) -> DataFrame:
    """A small fixed multimodal dataset."""
    rows = [("train", i, f"What is on picture {i}?", [f"thing {i}"], f"img{i}", f"images/img{i}.png") for i in (0, 1)]
    rows += [("dev", 2, "What is on picture 2?", ["thing 2"], "img2", "images/img2.png"), ("test", 3, "What is on picture 3?", ["thing 3"], "img3", "images/img3.png")]
    return spark.createDataFrame(rows, "split string, index int, question string, answers array<string>, image_id string, image_path string")


def catalogue_document(assets: list[dict], datasets: list[str] | None = None, required_only: bool = False) -> str:
    """The asset catalogue, filtered, as a JSON document."""
    kept = [a for a in assets if (not datasets or a["dataset"] in datasets) and (a.get("required") or not required_only)]
    return json.dumps({"count": len(kept), "assets": kept}, sort_keys=True)
