"""The inverted-list index against exact search, and keys that were glued."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import assembly, blocks, retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] * (i % 3 + 1) + rng.normal(size=16) * 0.4).tolist()) for i in range(900)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [0.0] * 16), (1004, [1.0] * 3), (1005, [float("nan")] * 16), (1006, [None] * 16)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)


def test_all_cells_are_exact_and_some_find_nine_of_ten(vectors):
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(vectors)
    assert {r.id for r in index.table.select("id").collect()} == {*range(900), 1000, 1001}
    exact = {tuple(r) for r in retrieval.dense_topk(vectors.where(F.size("vector") == 16), asked, 10).select("query_id", "id", "score", "rank").collect()}
    assert {tuple(r) for r in vector_index.search(index, asked, 10, len(index.cells)).select("query_id", "id", "score", "rank").collect()} == exact
    measured = vector_index.recall(index, vectors, asked, 10, 8).first()
    assert measured.recall >= 0.9 and measured.queries == 46 and measured.cells == 30
    probes = vector_index.probes_for(index, vectors, 0.98)
    assert probes < 30 and vector_index.recall(index, vectors, asked, 10, probes).first().recall >= 0.95
    assert vector_index.recall(vector_index.build(vectors, 12), vectors, asked, 10, 1).first().recall >= 0.5


def test_blocks_of_queries_and_no_rows(spark, vectors, monkeypatch):
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(vectors, 9)
    want = {tuple(r) for r in vector_index.search(index, asked, 3, 4).select("query_id", "id", "score", "rank").collect()}
    monkeypatch.setattr(vector_index, "MOST_QUERIES", 7)
    assert {tuple(r) for r in vector_index.search(index, asked, 3, 4).select("query_id", "id", "score", "rank").collect()} == want
    empty = vector_index.build(vectors.limit(0))
    assert empty.table.count() == 0 and vector_index.search(empty, asked, 3).count() == 0
    assert vector_index.search(index, asked.limit(0), 3).count() == 0


def test_tiles_change_nothing(vectors, monkeypatch):
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = {tuple(r) for r in retrieval.dense_topk(vectors, asked, 5).collect()}
    monkeypatch.setattr(retrieval, "TILE_VALUES", 500)
    assert {tuple(r) for r in retrieval.dense_topk(vectors, asked, 5).collect()} == want


def test_keys_with_nulls_and_separators_stay_apart(spark):
    facts = spark.createDataFrame([("x", None, 1, "a", ["f"]), (None, "x", 2, "b", ["f"]), ("p", "q", 3, "a", ["g"]), ("p", "q", 4, "b", ["g"])], "e string, t string, candidate long, value string, families array<string>")
    assert [(r.e, r.t, r.candidates) for r in assembly.conflict_findings(facts, ["e", "t"]).collect()] == [("p", "q", [3, 4])]


def test_chunks_of_blocks_without_an_id(spark):
    rows = [(i, p, "heading" if p == 0 else "paragraph", 1 if p == 0 else 0, f"words of {p}", p * 10) for i in (None, 7) for p in range(4)]
    parsed = spark.createDataFrame(rows, "document_id long, position int, kind string, level int, text string, start long")
    got = blocks.chunk_documents(parsed).collect()
    assert sorted(((r.document_id, r.section, r.chunk, r.first, r.last, r.tokens, r.context) for r in got), key=str) == [(7, 1, 0, 1, 3, 9, "words of 0"), (None, 1, 0, 1, 3, 9, "words of 0")]
