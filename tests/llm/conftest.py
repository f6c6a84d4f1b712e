"""Rows that every operator must take: nulls, empty and long texts, ties, repeats and columns with clashing names."""

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score double, n_words long, shard int, fp long, cell string, size int"


@pytest.fixture(scope="session")
def odd_rows():
    random.seed(11)
    long = " ".join(random.choice(("lorem", "ipsum", "dolor", "sit", "Amet.")) + str(random.randint(0, 99)) for _ in range(20_000))
    texts = [None, "", " ", "\n\n", "one", "One two three four five six", "one two three four five six", long, long, "x" * 5000, "é漢字😀\x00\x1f\x85 z", "a   b \n c\r\n", None]
    rows = [(i if i != 12 else None, t) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[0]]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, 0.5, 1, 2, 3, "c", 4) for i, t in odd_rows], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
