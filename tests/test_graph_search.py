"""Search in two graph indexes: what is embedded, what is found, and where it says it comes from."""

import pytest
from pyspark.sql import functions as F

from hyperweave.plans import search


def test_corpora(spark):
    entities = spark.createDataFrame([("A", "about a"), ("B", " "), ("C", None), (" ", "lost"), (None, "lost"), ("A", "about a")], "entity_name string, content string")
    hyperedges = spark.createDataFrame([("h1", "x", None), (None, "h2", False), ("", "h3", None), ("h4", "x", True), (None, None, None), ("h1", "y", None)], "content string, hyperedge_name string, deleted boolean")
    e, h = search.graph_corpora(entities, hyperedges)
    assert {tuple(r) for r in e.collect()} == {("A", "about a"), ("B", "B"), ("C", "C")} and e.count() == 3
    assert sorted(tuple(r) for r in h.collect()) == [(x, x) for x in ("h1", "h2", "h3")]


def test_hits_of_both_indexes(spark):
    vectors = lambda rows: spark.createDataFrame(rows, "id string, embedding array<float>")
    e, h = vectors([("E1", [1.0, 0.0]), ("E2", [0.5, 0.5]), ("E3", [0.0, 1.0])]), vectors([("h1", [0.9, 0.0]), ("h2", [0.0, 0.8])])
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "query string, embedding array<float>")
    got = search.graph_search(asked, e, h, 2, 1, dataset="d", subset="s").orderBy("query", "place").collect()
    assert [(r.query, r.place, r.modality, r.id, round(r.score, 4)) for r in got] == [("q", 0, "bge_entity", "E1", 1.0), ("q", 1, "bge_entity", "E2", 0.5), ("q", 2, "bge_hyperedge", "h1", 0.9), ("r", 0, "bge_entity", "E3", 1.0), ("r", 1, "bge_entity", "E2", 0.5), ("r", 2, "bge_hyperedge", "h2", 0.8)]
    assert got[2].provenance.asDict() == {"dataset": "d", "subset": "s", "index": "bge_hyperedge", "rank": 0, "embedding_id": "h1", "store_path": "kv_store_hyperedges.json"} and got[2].knowledge == "h1" and got[2].coherence == got[2].score
    assert {r.modality for r in search.graph_search(asked, e, h, 0, 2).collect()} == {"bge_hyperedge"}
    with pytest.raises(ValueError):
        search.graph_search(asked, e, h, 0, 0)
    told = lambda entity_hits, hyperedge_hits: hyperedge_hits.where("query = 'q'").withColumn("knowledge", F.lit("from the graph"))
    got = search.graph_search(asked, e, h, 2, 1, context=told)
    assert [r.knowledge for r in got.where("query = 'q'").collect()] == ["from the graph"] and got.where("query = 'r'").count() == 3
