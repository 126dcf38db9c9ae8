"""Corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

quality      documents that the line chain rejects go
duplicates   of documents whose shingle sets link, those of the smallest id stay
benchmark    words inside benchmark windows are cut out; a document of nothing else goes
privacy      identifiers and the terms that disclose them are generalised in place
tokens       BPE ids of what is left beside the text, with digests of the ids and of what they decode to

Contract. Every stage takes all rows that the one before it kept and returns their columns, extra ones too; the last adds
ids, n_tokens, ids_sha256 and decoded_sha256. Null and empty texts are scored as one empty line, link with nothing, hold
nothing to cut, and have no ids; rows with a null id are never duplicates and never train. Rows that share an id share
its component: where an id is not its component's smallest, all of its rows go. An empty table stays empty. n_chars, where
it is there, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperweave.llm import bpe, decontamination, parity, pii, quality
from hyperweave.llm.common import read_table, scratch
from hyperweave.llm.queries import TOKENIZERS


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity.deduplicate(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.sanitise(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenise(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("quality", good), ("duplicates", unlike), ("benchmark", untested), ("privacy", private), ("tokens", encoded)]
#: The first stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
