"""A knowledge base's artifacts with content-addressed manifests: what is still good is used again, what changed is encoded.

Every artifact (a corpus of rows (id, content) with an embedding each) has versions, and with each version a manifest: the
fingerprint of its rows, the encoder's name, count and dimension. A build decides for each artifact:

reuse     same fingerprint, encoder and dimension, and the stored vectors pass the serving gate: nothing is done
repair    same encoder; contents seen before keep their vectors, the others are encoded; so are all if vectors are damaged
rebuild   no version yet, or another encoder or dimension: everything is encoded

A version is served only after its check; a failed build leaves the one before.

Contract. Null contents count as empty. Ids are unique; repeated ones are an error of the gate. An empty corpus is an
error of the gate as well. Equal contents are encoded once for each copy that has no older one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merges import fingerprint
from ..operators.vectors import check_index, reindex
from ..session import settled
from ..streaming.versions import Versions
from .construction import insert_documents, offline_extractor

Encoder = Callable[[Column], Column]
MANIFEST = "artifact string, decision string, fingerprint string, encoder string, n long, dimension int, encoded long"


def manifest(spark: SparkSession, root: str, artifact: str) -> dict | None:
    """The manifest that is served, None without one."""
    held = Versions(spark, f"{root}/{artifact}")
    version = held.current()
    return None if version is None else held.read("manifest").first().asDict() | {"version": version}


def read_artifact(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """(id, content, embedding)."""
    return Versions(spark, f"{root}/{artifact}").read("vectors")


def decide(known: dict | None, print_: str, encoder: str, dimension: int | None, blockers: list[str]) -> str:
    if known is None or known["encoder"] != encoder or (dimension is not None and known["dimension"] != dimension):
        return "rebuild"
    return "reuse" if known["fingerprint"] == print_ and not blockers else "repair"


def build_artifact(rows: DataFrame, encode: Encoder, root: str, artifact: str, encoder: str, dimension: int | None = None) -> dict:
    """Brings one artifact up to rows (id, content), and returns what was done as a row of MANIFEST."""
    spark, held = rows.sparkSession, Versions(rows.sparkSession, f"{root}/{artifact}")
    new = settled(rows.select(F.col("id").cast("string").alias("id"), F.coalesce("content", F.lit("")).alias("content")))
    print_ = fingerprint(new.select(F.to_json(F.struct("id", "content")).alias("x")), "x").first().fingerprint
    known = manifest(spark, root, artifact)
    blockers = []
    if known is not None:
        gate = check_index(held.read("vectors"), "id", "embedding", known["dimension"]).first()
        blockers = [*gate.blockers, *(["count differs"] if gate.n != known["n"] else [])]
    decision = decide(known, print_, encoder, dimension, blockers)
    if decision == "reuse":
        return {k: known[k] for k in ("artifact", "fingerprint", "encoder", "n", "dimension")} | {"decision": decision, "encoded": 0}
    old = None
    if decision == "repair" and not blockers:
        old = held.read("vectors").select(F.col("id").alias("pos"), "content", "embedding")
    if old is None:
        old = spark.createDataFrame([], "pos string, content string, embedding array<float>")
    made = settled(reindex(new.select(F.col("id").alias("pos"), "content"), old, encode))
    size = made.agg(F.max(F.size("embedding")).alias("d"), F.count("*").alias("n"), F.count_if(~F.col("reused")).alias("e")).first()
    told = {"artifact": artifact, "decision": decision, "fingerprint": print_, "encoder": encoder, "n": size.n, "dimension": size.d, "encoded": size.e}

    def gate(versions: Versions, version: int) -> list[str]:
        return check_index(versions.read("vectors", version), "id", "embedding", dimension).first().blockers

    names = [c.split()[0] for c in MANIFEST.split(", ")]
    told_rows = spark.createDataFrame([tuple(told[n] for n in names)], MANIFEST)
    held.commit({"vectors": made.select(F.col("pos").alias("id"), "content", "embedding"), "manifest": told_rows}, gate, decision)
    return told


def build_base(docs: DataFrame, text: str, encode: Encoder, root: str, encoder: str, extract: Callable[[Column], Column] = offline_extractor, dimension: int | None = None, **chunking) -> DataFrame:
    """A knowledge base of documents: its graph tables written below root, and indexes of its entities and hyperedges, each
    reused, repaired or rebuilt. One row for each artifact (MANIFEST)."""
    spark = docs.sparkSession
    tables = insert_documents(docs, text, extract=extract, **chunking)
    graph = Versions(spark, f"{root}/graph")
    graph.commit({n: tables[n] for n in ("full_docs", "chunks", "hyperedges", "entities", "incidence")}, note="build")
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    told = [build_artifact(tables[f"{n}_kv"], encode, root, n, encoder, dimension) for n in ("entities", "hyperedges")]
    return spark.createDataFrame([tuple(t[n] for n in names) for t in told], MANIFEST)
