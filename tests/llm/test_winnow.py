"""Winnowing where words are long, hashes equal and items many."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pytest

from stratum.llm import winnow


def thue_morse(n, swap=False):
    return "".join("ab"[(i.bit_count() & 1) ^ swap] for i in range(n))


def digest(*ids):
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_words_whose_polynomial_hashes_are_equal(spark):
    one, two = thue_morse(1024), thue_morse(1024, True)
    nine = " ".join(f"w{i}" for i in range(9))
    items = [("A", one), ("B", two), ("C", f"{nine} {one}"), ("D", f"{nine} {two}")]
    docs = [(1, one), (2, two), (3, f"x {nine} {one} y"), (4, f"{nine} {two}"), (5, nine)]
    got = {r.doc_id: r for r in winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert [(got[i].n_hit, got[i].items_sha256) for i in range(1, 6)] == [(1, digest("A")), (1, digest("B")), (10, digest("A", "C")), (10, digest("B", "D")), (0, digest())]


def test_equal_hashes_are_chained(monkeypatch):
    real = winnow.Words.grams

    def coarse(self, k, salt=0):
        hashes, whole = real(self, k, salt)
        return hashes % np.uint64(7), whole

    monkeypatch.setattr(winnow.Words, "grams", coarse)
    items = [(str(i), " ".join(f"v{(i * 7 + j) % 40}" for j in range(4 + i % 9)).encode()) for i in range(60)]
    texts = [b" ".join(t for _, t in items[i : i + 3]) for i in range(0, 60, 3)]
    index = winnow.Index(items)
    hit, found = index.search(winnow.Words(texts, index.known))
    for k, text in enumerate(texts):
        w = text.split()
        want = set()
        for i, (_, t) in enumerate(items):
            x = t.split()
            m = min(len(x), 10)
            windows = {tuple(x[j : j + m]) for j in range(len(x) - m + 1)}
            if any(tuple(w[j : j + m]) in windows for j in range(len(w) - m + 1)):
                want.add(i)
        assert found.get(k, set()) == want
    assert hit.all()


def test_blocks_count_items_and_skip_those_without_words(spark):
    empty = spark.range(200_000).selectExpr("cast(id as string) as item_id", "if(id % 2 = 0, '', '-- ?') as text")
    one = spark.createDataFrame([("x", "é"), (None, "b"), ("n", None)], "item_id string, text string")
    n, parts = winnow._item_blocks(empty.unionByName(one), winnow.INDEX_BYTES)
    assert n == 1 and sorted(t for _, t in next(parts)) == [b"b", "é".encode()]
    tiny = spark.range(3000).selectExpr("cast(id as string) as item_id", "'a' as text")
    n, parts = winnow._item_blocks(tiny, 1 << 16)
    sizes = [len(p) for p in parts]
    assert n > 1 and sum(sizes) == 3000 and max(sizes) * winnow.ITEM_BYTES < 1 << 16
    docs = spark.createDataFrame([(1, "a z"), (2, "z")], "doc_id long, text string")
    got = winnow.decontaminate(docs, tiny, index_bytes=1 << 16).orderBy("doc_id").collect()
    assert [(r.n_hit, r.n_items) for r in got] == [(1, 3000), (0, 0)]


@pytest.mark.parametrize("length", [6, 60])
def test_memory_of_an_index_and_a_long_text(length):
    rng = np.random.default_rng(1)
    items = [(str(i), b" ".join(b"%x" % x for x in rng.integers(0, 1 << 30, length * 3))) for i in range((2 << 20) // (length * 24))]
    tracemalloc.start()
    index = winnow.Index(items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 350 << 20
    text = b" ".join([items[3][1]] + [b"filler"] * 300_000 + [items[7][1]])
    tracemalloc.start()
    hit, found = index.search(winnow.Words([text], index.known))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == {0: {3, 7}} and hit.sum() == length * 6 and peak < 60 * len(text)
