"""Searches of many questions: equal ones asked once, best passages by batches with floors and in blocks, patterns behind their signs."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa

from stratum.functions import identifiers as I
from stratum.functions import text as T
from stratum.operators import lexical, search


def test_equal_questions_are_searched_once_and_all_answered(spark, monkeypatch):
    passages = spark.createDataFrame([("a", "Install the relay with relayctl 2.4.1", None, "2.4.1"), ("b", "bananas ripen", None, None)], "chunk_id string, text string, source_class string, version string")
    asked, inner = [], search.lexical_hits
    monkeypatch.setattr(search, "lexical_hits", lambda p, q, limit: (asked.extend(r.query_id for r in q.collect()), inner(p, q, limit))[1])
    questions = spark.createDataFrame([(f"q{n}", "relay 2.4.1") for n in range(4)] + [("x", "pears E9999"), ("y", "pears E9999"), ("z", None), ("w", "")], "query_id string, text string")
    found = search.search(passages, questions)
    assert len(asked) == 3
    assert sorted((r.query_id, r.chunk_id) for r in found.evidence.collect()) == [(f"q{n}", "a") for n in range(4)]
    gaps = {(r.query_id, r.position): r.gap for r in found.gaps.collect()}
    assert gaps["x", 0] == gaps["y", 0] == gaps["z", 0] == gaps["w", 0] and gaps["x", 1] == gaps["y", 1]
    assert found.passes.count() == 8


def test_best_passages_with_floors_and_in_blocks(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"w{n}" for n in range(30)]
    texts = [(n, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for n in range(300)] + [(n, "w1 w2 w3") for n in range(300, 340)] + [(400, ""), (401, None)]
    asked = [(n, " ".join(draw.choices(words, k=3))) for n in range(12)] + [(12, "w1 w2"), (13, "zebra"), (14, None)]
    docs, queries = spark.createDataFrame(texts, "id long, text string").repartition(5), spark.createDataFrame(asked, "q long, text string")
    take = lambda: sorted(map(tuple, lexical.bm25_topk(docs, queries, "id", "text", "q", "text", 7).collect()))
    plain = take()
    assert {q for q, *_ in plain} == set(range(13)) and all(r <= 7 for *_, r in plain)
    # Each of 12 queries by hand.
    bags = {n: (t or "").split() for n, t in texts}
    average = sum(map(len, bags.values())) / len(bags)
    import math

    for q, text in asked[:13]:
        score = {}
        for w in set(text.split()):
            df = sum(w in b for b in bags.values())
            for n, b in bags.items():
                if w in b:
                    tf = b.count(w)
                    score[n] = score.get(n, 0) + math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(b) / average))
        want = sorted(score, key=lambda n: (-round(score[n], 6), n))[:7]
        assert [n for _, n, _, _ in sorted((r for r in plain if r[0] == q), key=lambda r: r[3])] == want
    monkeypatch.setattr(lexical, "MOST_UNBOUNDED", 0)
    assert take() == plain
    monkeypatch.setattr(lexical, "MOST_BROADCAST", 8)
    assert take() == plain
    assert lexical.bm25_topk(docs, queries.where("q >= 13"), "id", "text", "q", "text").count() == 0


def test_a_batch_gives_no_row_for_each_pair():
    """A thousand passages that all share a word with a query give its best ones only, and none below a floor."""
    rows = [{"id": n, "length": 2 + n % 5, "terms": [{"term": "a", "tf": 1}, {"term": f"x{n}", "tf": 1}]} for n in range(1000)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())])))]))
    import numpy as np

    asked = (pa.array(["a"]), np.array([1.0]), pa.array(["q"]), np.array([0]), np.array([0, 1]))
    out = pa.Table.from_batches(lexical.score_batches([batch], asked, np.zeros(1), 4.0, 10))
    assert out.column("id").to_pylist() == list(range(0, 50, 5))
    best = out.column("score")[0].as_py()
    assert pa.Table.from_batches(lexical.score_batches([batch], asked, np.array([best]), 4.0, 500)).num_rows == 200
    assert list(lexical.score_batches([batch], asked, np.array([best + 1]), 4.0, 500)) == []


def test_signs_hide_no_identifier(spark):
    draw = random.Random(11)
    parts = ["`a b`", "`", "C:\\x", "./a", "../b", "~/c", "/usr/x", "a.md", "x.y1", "v2", "V1.2.3", "1.2", "10.0.0.1.", "port 80", "PORT  8080", ":443", ":0", "E4042", "AB-12", "Q_123x", "ERR-00", "--flag", "-f", "a=b", "$X", "${Y}", "word", "é.ab", " ", "\n", "\t", ",", "(", ")", ".", "-", "="]
    texts = [(n, "".join(draw.choice(parts) + draw.choice(["", " ", "\n"]) for _ in range(draw.randint(0, 7)))) for n in range(3000)]
    got = {r.n: r.i for r in spark.createDataFrame([*texts, (3000, None)], "n long, t string").selectExpr("n", f"{I.index_identifiers('t')} AS i").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (n BIGINT, t VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", texts)
    want = dict(con.execute(f"SELECT n, {I.index_identifiers('t', T.DUCK)} FROM x").fetchall())
    assert got.pop(3000) is None
    assert got == want
    assert "CASE WHEN NOT" in I.found("t", "version")
