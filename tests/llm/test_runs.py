"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import runs
from tests.llm.conftest import SF


def plain_runs(w, least=24, times=3):
    """(start, length, period) by trying every period over all words; a period that a smaller one divides into is not the smallest."""
    out = set()
    codes = np.unique(np.array(w, object), return_inverse=True)[1] if w else np.zeros(0, int)
    n = len(codes)
    for p in range(1, n // times + 1):
        same = np.concatenate([[0], (codes[p:] == codes[:-p]).astype(int), [0]])
        for s, e in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
            length = e - s + p
            stretch = codes[s : s + length]
            if length >= max(least, times * p) and not any((stretch[q:] == stretch[:-q]).all() for q in range(1, p)):
                out.add((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = planted(doc_id, (text or "").encode().split())
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (6, 2), (1, 5)])
def test_all_runs_of_many_documents(least, times):
    rng = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(0, 5)):
            n, k = rng.choice((0, 1, 5, 23, 24, 30, 60, 120, 200)), rng.choice((1, 2, 2, 3, 5))
            w = [rng.randint(1, k) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a, p, e = rng.randrange(n), rng.randint(1, max(1, n // 3)), rng.randint(0, n)
                for i in range(a, e):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        got = runs.find_runs(np.array(sum(docs, []), np.int64), np.array([len(d) for d in docs], np.int64), least, times)
        assert [tuple(map(int, r)) for r in got] == [(d, *r) for d, w in enumerate(docs) for r in plain_runs(w, least, times)]


def test_long_periods_and_words_of_fibonacci():
    a, b = [1], [1, 2]
    while len(b) < 3000:
        a, b = b, b + a
    assert [tuple(map(int, r))[1:] for r in runs.find_runs(np.array(b), np.array([len(b)]), 6, 2)] == plain_runs(b, 6, 2)
    rng = np.random.default_rng(0)
    root = rng.integers(1, 1 << 40, 70_000)
    found = runs.find_runs(np.concatenate([[5], np.tile(root, 4)[:-3], [5]]), np.array([4 * len(root) - 1]))
    assert [tuple(map(int, r)) for r in found] == [(0, 1, 4 * len(root) - 3, len(root))]


def test_words_are_split_at_ascii_space_only():
    texts = [b"", b" ", b" a\tb\n\x0b\x0c\r c ", "x\x85y z \x1c\x1f\x00 q".encode(), b"\xff \xfe"]
    words, codes, counts = runs.word_codes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert words.cast(pa.large_binary()).to_pylist() == sum((t.split() for t in texts), [])
    assert len(set(codes.tolist())) == len(set(sum((t.split() for t in texts), [])))


def test_odd_rows(spark, odd, odd_rows, none):
    random.seed(3)
    extra = [(i, " ".join(random.choice("abc") for _ in range(random.randint(0, 150)))) for i in range(1000, 1200)]
    docs = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in [*odd_rows, *extra]], "doc_id long, text string, runs string, h int, n int")
    got = runs.run_digests(runs.periodic_runs(runs.with_planted_periods(docs))).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(plain_row(*r) for r in [*odd_rows[:7], *odd_rows[9:], *odd_rows[7:9], *extra])
    assert sum(r.n_runs > 0 for r in got) >= 10
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_periods(none))).count() == 0
    assert runs.periodic_runs(odd).count() == len(odd_rows)


def test_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in runs.op13_periodic_runs(spark, SF).collect()}
    small = [r for r in rows if len((r[1] or "").split()) < 3000]
    want = {plain_row(*r) for r in small}
    assert want <= got and len(got) == len(rows)
    assert any(r[1] for r in want)
