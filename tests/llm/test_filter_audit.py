"""The filter audit against a plain count."""

from __future__ import annotations

import random
from collections import Counter
from itertools import permutations

import pytest

from stratum.llm import filter_audit
from tests.llm.conftest import SF


def plain_masks(rows):
    """(doc_id, part, mask) of rows (doc_id, text, part), a filter at a time."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    for i, t, part in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i]
        out[i, part or "", sum(1 << k for k, x in enumerate(fails) if x)] += 1
    return out


def plain_audit(masks, labels):
    """Rows of the audit by going through every document in every order."""
    parts = {p for _, p, _ in masks}
    out, first = {}, Counter()
    for part in parts:
        mine = [(m, n, labels.get(i, (0, 0))) for (i, p, m), n in masks.items() if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[0] & bit]
                stay = [x for x in left if not x[0] & bit]
                failing = sum(n for m, n, _ in mine if m & bit)
                removed = sum(n for _, n, _ in gone)
                out[part, order, step + 1] = [sum(n for _, n, _ in stay), removed, failing - removed, sum(n for m, n, _ in mine if m == bit), sum(n * g for _, n, (g, _) in gone), sum(n * x for _, n, (_, x) in gone)]
                first[part, letter] += removed
                left = stay
    return {(*k, *v, first[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    words = [" ".join(random.choice(("Lorem", "ipsum", "dolor", "sit", "AMET")) + str(random.randint(0, k)) for _ in range(n)) for n, k in ((3, 9), (250, 9), (250, 900), (199, 900), (200, 900), (9000, 3))]
    texts = [None, "", " ", "#", "é漢字😀 Z\x85 z", "a|b", *words]
    out = [(i if i % 37 else None, texts[i * i % len(texts)], (None, "", "en", "fr")[i % 4]) for i in range(300)]
    return out + out[:5] + [(7, words[2], "en")] * 3 + [(i, "copied", "xx") for i in range(400)]


@pytest.mark.parametrize("ranges", ["1", "4", "97"])
def test_masks_whatever_the_ranges(spark, rows, ranges):
    docs = spark.createDataFrame([(*r, 1.0, b"x", "p") for r in rows], "doc_id long, text string, lang string, mask double, digest binary, part string").repartition(7)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = filter_audit.failure_masks(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert Counter(map(tuple, got)) == plain_masks(rows)


def test_audit(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 300, 3)]
    labels = spark.createDataFrame([*marks, (3, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.part_counters(filter_audit.failure_masks(docs), labels))
    assert {tuple(r[c] for c in COLUMNS) for r in got.collect()} == plain_audit(plain_masks(rows), {i: (q, t) for i, q, t in marks})
    assert got.count() == 600 * len({p or "" for _, _, p in rows})


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.part_counters(filter_audit.failure_masks(docs), labels)).count() == 0


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = {r.doc_id: (int(r.quality == 1), int(r.toxic == 1)) for r in labels.collect()}
    got = filter_audit.op12_filter_interaction_audit(spark, SF).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == plain_audit(plain_masks(rows), marks)
