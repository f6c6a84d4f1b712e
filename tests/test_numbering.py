"""Numbers by sorted ranges, lookups of hot keys, and bootstraps in blocks against one block."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratum.operators import dedup, evaluation, numbering
from stratum.runtime import settle
from stratum.streaming import journal


def test_numbers_of_a_hot_group_and_of_nulls(spark):
    # A third of all rows has one key, some have none.
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), (F.col("id") * 7919 % 3001).alias("at"))
    got = numbering.numbered(rows, ["at"], "n", by="key").collect()
    want = {}
    for r in sorted(((r.key, r.at) for r in rows.collect()), key=lambda x: (x[0] or "", x[1])):
        want.setdefault(r[0], []).append(r[1])
    assert {(r.key, r.at): r.n for r in got} == {(k, at): i for k, ats in want.items() for i, at in enumerate(ats)}
    whole = numbering.numbered(rows, ["key", "at"], "n").collect()
    assert sorted(r.n for r in whole) == list(range(3000))
    assert [r.at for r in sorted(whole, key=lambda r: r.n)] == [at for k in sorted(want, key=lambda k: (k is not None, k)) for at in want[k]]
    assert numbering.numbered(rows.limit(0), ["at"], "n", by="key").isEmpty()


def test_repeated_rows_and_sequences_after_a_start(spark):
    events = spark.createDataFrame([("s", 1), ("s", 1), ("s", 1), ("t", 5), (None, 2)], "stream string, at int")
    start = spark.createDataFrame([("s", 10)], "stream string, last long")
    assert sorted(r.sequence for r in journal.sequenced(events, "stream", ["at"]).where("stream = 's'").collect()) == [1, 2, 3]
    got = Counter((r.stream, r.sequence) for r in journal.sequenced(events, "stream", ["at"], start).collect())
    assert got == Counter([("s", 11), ("s", 12), ("s", 13), ("t", 1), (None, 1)])


def test_hot_keys_are_looked_up_alike(spark, monkeypatch):
    facts = settle(spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 != 1, F.col("id") % 80).alias("k")), "facts")
    dims = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = sorted(map(tuple, numbering.looked_up(facts, "k", dims).select("id", "k", F.coalesce("v", F.lit(-1))).fillna(-1).collect()))
    monkeypatch.setattr(numbering, "HOT_LEAST", 10)
    assert sorted(map(tuple, numbering.looked_up(facts, "k", dims).select("id", "k", F.coalesce("v", F.lit(-1))).fillna(-1).collect())) == plain
    assert len(plain) == 900


def test_occurrences_with_many_copies_of_the_empty_text(spark, monkeypatch):
    monkeypatch.setattr(numbering, "HOT_LEAST", 10)
    docs = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("text"))
    rows = docs.collect()
    least = {}
    for r in rows:
        least[r.text or ""] = min(least.get(r.text or "", r.id), r.id)
    assert {(r.id, r.representative) for r in dedup.occurrences(docs, "id", "text").collect()} == {(r.id, least[r.text or ""]) for r in rows}


def test_components_through_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr(numbering, "HOT_LEAST", 5)
    star = [(0, i, 0.9) for i in range(1, 40)] + [(39, 40, 0.95), (100, 101, 1.0)]
    got = dedup.groups(spark.createDataFrame(star, "a long, b long, jaccard double")).collect()
    assert {r.member: r.root for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert {r.member: r.jaccard for r in got}[40] == 0.95


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_bootstrap_in_blocks(spark, monkeypatch, block):
    items = spark.range(61).select((F.col("id") % 3).alias("s"), F.col("id").alias("o"), F.when(F.col("id") != 60, F.col("id") * 37 % 11).alias("v"))
    whole = evaluation.bootstrap_interval(items, "v", "s", "o", 7, resamples=60).first()
    monkeypatch.setattr(evaluation, "ITEM_BLOCK", block)
    monkeypatch.setattr(evaluation, "DRAW_SLICE", 5)
    monkeypatch.setattr(evaluation, "RESAMPLE_BLOCK", 25)
    got = evaluation.bootstrap_interval(items, "v", "s", "o", 7, resamples=60).first()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in whole]
    # A value that isn't there takes no part.
    assert round(got.mean, 9) == round(sum(i * 37 % 11 for i in range(60)) / 60, 9)
    assert evaluation.bootstrap_interval(items.limit(0), "v", "s", "o", 7, resamples=5).isEmpty()
