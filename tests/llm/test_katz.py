"""The Katz model against a plain recursive one, and its sums."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratum.llm import katz
from tests.llm.conftest import SF


def tokens_of(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in (text or "").encode().split()] + [b""]


class Plain:
    """Counts in dictionaries, probabilities by recursion."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            w = tokens_of(t)
            for m in range(1, order + 1):
                self.counts[m].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
        self.d = [None]
        for m in range(1, order + 1):
            seen = Counter(self.counts[m].values())
            self.d.append(self.factors([seen[r] for r in range(1, 7)]))
        self.follow = defaultdict(dict)
        for m in range(2, order + 1):
            for g, c in self.counts[m].items():
                self.follow[g[:-1]][g[-1]] = c
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.freed = math.fsum(c * (1 - self.d[1].get(c, 1)) for c in self.counts[1].values())
        self.kept = {}
        self.shares, self.totals = {}, {}

    @staticmethod
    def factors(n):
        for k in range(5, 0, -1):
            if all(n[: k + 1]):
                a = (k + 1) * n[k] / n[0]
                d = {r: ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a) for r in range(1, k + 1)} if a < 1 else {1: -1}
                if all(0 < x < 1 for x in d.values()):
                    return d
        return {}

    def p(self, h, w):
        if not h:
            freed = self.freed
            total = self.n + (freed <= 0)
            c = self.counts[1][(w,)]
            return self.d[1].get(c, 1) * c / total if c else (freed or 1) / total
        if (h, w) not in self.kept:
            self.kept[h, w] = self._p(h, w)
        return self.kept[h, w]

    def _p(self, h, w):
        seen = self.follow.get(h)
        if not seen:
            return self.p(h[1:], w)
        d = self.d[len(h) + 1]
        if h not in self.totals:
            freed = sum(c * (1 - d.get(c, 1)) for c in seen.values())
            self.totals[h] = freed, sum(seen.values()) + (freed <= 0)
        freed, total = self.totals[h]
        if w in seen:
            return d.get(seen[w], 1) * seen[w] / total
        if h not in self.shares:
            self.shares[h] = (freed if freed > 0 else 1) / total / (1 - math.fsum(self.p(h[1:], x) for x in seen))
        return self.shares[h] * self.p(h[1:], w)

    def score(self, text, order):
        w = tokens_of(text)
        return math.fsum(math.log10(self.p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["a", "b", "The", "the", "C", *(f"w{i}" for i in range(60))]
    return [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))) for i in range(150)]


def checked(got, rows, order, held):
    plain = Plain([t for i, t in rows if not held(i)], order)
    kept = {}
    want = Counter()
    for i, t in rows:
        w = tokens_of(t)
        known = sum(plain.counts[1][(x,)] > 0 for x in w)
        base = sum(math.log10((plain.counts[1][(x,)] + 1) / (plain.n + plain.v + 1)) for x in w)
        if t not in kept:
            kept[t] = plain.score(t, order)
        want[i, held(i), len(w), known, plain.n, round(base, 6), round(kept[t], 6)] += 1
    found = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert found == want
    return plain


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_and_sums(spark, texts, order):
    docs = spark.createDataFrame([(i, t, 1, 2, b"x") for i, t in texts], "doc_id long, text string, n int, block int, words binary").repartition(5)
    model = katz.fit(docs, order, held_out="doc_id % 5 = 1")
    plain = checked(katz.scores(model).collect(), texts, order, lambda i: i % 5 == 1)
    words = {r.id: bytes(r.word) for r in model.words().collect()}
    assert Counter({(bytes(r.word),): r.n for r in model.words().collect() if r.n}) == plain.counts[1]
    if order > 1:
        got = {(words[r.context], words[r.word]): r.n for r in model.grams(2).collect()}
        assert got == dict(plain.counts[2])
        weights = {words[r.context]: (r.total, r.weight) for r in model.weights(2).collect()}
        assert set(weights) == {h[0] for h in plain.follow if len(h) == 1}
        # With the unknown word, each context's probabilities add up to one.
        every = [w for (w,) in plain.counts[1]] + [b"never seen"]
        for h in weights:
            assert math.isclose(math.fsum(plain.p((h,), w) for w in every), 1, rel_tol=1e-12)
            d = plain.d[2]
            kept = math.fsum(d.get(c, 1) * c / weights[h][0] for c in plain.follow[(h,)].values())
            assert math.isclose(kept + weights[h][1] * math.fsum(plain.p((), w) for w in every if w not in plain.follow[(h,)]), 1, rel_tol=1e-12)


def test_odd_rows(spark, odd, odd_rows, none):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = katz.scores(katz.fit(odd, held_out=katz.HELD_OUT)).collect()
    checked(got, odd_rows, 2, held)
    assert katz.scores(katz.fit(none)).count() == 0
    # Nothing to learn from: all words are unknown.
    got = katz.scores(katz.fit(odd, held_out="true")).collect()
    assert {(r.train_tokens, r.n_known, r.score, r.base_score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_whole_table(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = katz.op11_katz_lm_scores(spark, SF).collect()
    checked(got, rows, 2, lambda i: zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_discounts_and_packing():
    assert katz.discounts([10, 0, 3]).tolist() == [0.0]
    assert katz.discounts([1, 5, 1, 1, 1, 1]).tolist() == [0.0]
    d = katz.discounts([1000, 300, 120, 60, 33, 20])
    assert len(d) == 6 and all(0 < x < 1 for x in d[1:])
    rng = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), np.array([-(1 << 62), 1 << 62]), rng.integers(-300, 300, 1000), rng.integers(0, 1 << 40, 1000)):
        assert (katz.unpack(katz.pack(x)) == x).all() and (katz.unpack(katz.pack(np.sort(x), True)) == np.sort(x)).all()
