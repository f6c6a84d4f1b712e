"""Operators on small rows: goldens, ties, nulls and brute force."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratum.functions import identifiers as I
from stratum.functions import text as T
from stratum.operators import dedup, evaluation, evidence, inventory, lexical, quality, retrieval
from stratum.sources import corpus
from stratum.streaming import journal


def terms(spark, text):
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    cut = docs.select(F.posexplode(F.expr(T.tokens(T.fold("text")))).alias("p", "t"))
    return [r.w for r in cut.orderBy("p").select(F.expr(T.term("t")).alias("w")).collect() if r.w is not None]


def test_terms_golden(spark):
    assert terms(spark, "The scheduler marks the run as failed once it reaches max_retries.") == ["schedul", "mark", "run", "fail", "onc", "reach", "max_retries", "max", "retri"]
    assert terms(spark, "HTTPServer IDs Œuvre réseaux base64Encoder") == ["httpserv", "http", "serv", "id", "oeuvr", "reseau", "base64encoder", "base64", "encod"]
    assert terms(spark, "") == []


@pytest.mark.parametrize(
    ("word", "stem"),
    [("chevaux", "cheval"), ("bateaux", "bateau"), ("planned", "plan"), ("stopping", "stop"), ("agreed", "agr"), ("embedded", "embed"), ("policy", "polici"), ("installee", "install"), ("bus", "bus"), ("class", "class"), ("used", "used"), ("tried", "tri"), ("x2ed", "x2ed")],
)
def test_stem(spark, word, stem):
    assert spark.sql(f"SELECT {T.stem('w')} AS s FROM VALUES ('{word}') AS t(w)").first().s == stem


def test_identifiers_and_kind(spark):
    text = "see C:\\a\\b, ./x/y.py or a.conf at v1.2.3 on port 8080; E-404 `ls -la` --force $HOME 1.2.3.4.5"
    row = spark.createDataFrame([(text,)], "t string").select(F.expr(I.index_identifiers("t")).alias("i"), F.expr(I.kind("t")).alias("k")).first()
    assert {"C:\\a\\b", "./x/y.py", "a.conf", "v1.2.3", "8080", "E-404", "ls -la", "--force", "$HOME"} <= set(row.i)
    assert not any("4.5" in i for i in row.i) and row.i == sorted(row.i) and row.k == "troubleshooting"
    asked = spark.createDataFrame([("How many documents?",), ('liste des versions dans le lot "a b"',), ("how many",)], "t string")
    assert [r[0] for r in asked.select(F.expr(I.inventory_request("t"))).collect()] == ["count_documents", "list_versions", None]


def test_token_id_and_weights(spark):
    assert spark.sql(f"SELECT {T.token_id('w')} AS i FROM VALUES ('abc') AS t(w)").first().i == int(hashlib.sha256(b"abc").hexdigest()[:8], 16)
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, ""), (3, None)], "id long, text string")
    tf = lexical.term_frequencies(docs, "id", "text")
    assert {(r.term, r.tf, r.length) for r in tf.collect()} == {("alpha", 2, 3), ("beta", 1, 3)}
    assert lexical.average_length(tf, docs).first().average_length == 1.0
    assert lexical.average_length(tf.limit(0), docs.limit(0)).first().average_length == 0.0


def test_quality_decision(spark):
    good = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, good), (2, "Sign in"), (3, good + " �"), (4, good + " AKIA" + "A" * 16), (5, None), (6, "Page not found\n" + good)], "id long, text string")
    got = {r.id: (r.outcome, r.rules) for r in quality.decide(quality.flags(docs)).collect()}
    assert got[1] == ("accepted", []) and got[4][0] == "quarantined" and got[3][0] == "needs_reextraction"
    assert got[2] == ("needs_reextraction", ["body.near-empty", "page.sign-in"]) and got[5] == ("needs_reextraction", ["body.near-empty"]) and got[6][1] == ["page.application-error"]
    kept = quality.flags(docs).withColumns({"kept": F.when(F.col("id") == 2, "excluded"), "ledger": F.lit("accepted"), "failed": F.col("id") == 4})
    out = {r.id: (r.outcome, r.decided_by) for r in quality.decide(kept, "kept", "ledger", "failed").collect()}
    assert out[2] == ("excluded", "kept") and out[4] == ("quarantined", "rule") and out[5] == ("accepted", "ledger")


def test_near_duplicates_brute_force(spark):
    random.seed(3)
    base = [[f"w{random.randint(0, 50)}" for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:-1], "x"]) for b in base] + ["", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set() if not t.split() else {" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if sets[a] and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * 85}
    pairs = dedup.confirmed_pairs(docs, "id", "text")
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert want <= {(r.a, r.b) for r in dedup.candidate_pairs(dedup.minhash_signatures(docs, "id", "text")).collect()}
    groups = dedup.groups(pairs).collect()
    assert all(r.group_id == "near-" + hashlib.sha256(json.dumps(sorted(str(x.member) for x in groups if x.root == r.root), separators=(",", ":")).encode()).hexdigest() for r in groups)


def test_candidates_are_all_pairs_of_a_bucket(spark):
    random.seed(8)
    rows = [(i, [random.randint(0, 2) for _ in range(128)] if i % 3 else [7] * 64 + [i] * 64) for i in range(60)] + [(99, None)]
    held = [(i, s) for i, s in rows if s]
    want = {(a, b) for a, s in held for b, t in held if a < b and any(s[k : k + 4] == t[k : k + 4] for k in range(0, 128, 4))}
    frame = spark.createDataFrame(rows, "id long, signature array<long>")
    for block in (3, 2048):
        got = [(r.a, r.b) for r in dedup.candidate_pairs(frame, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_dense_topk_in_blocks(spark):
    random.seed(9)
    frame = spark.createDataFrame([(i, [random.uniform(-1, 1) for _ in range(4)]) for i in range(40)], "id long, vector array<double>")
    queries = frame.where("id % 2 = 0").withColumnRenamed("id", "query_id")
    whole, parted = (Counter(map(tuple, retrieval.dense_topk(frame, queries, 5, most).collect())) for most in (100, 7))
    assert parted == whole and sum(parted.values()) == 100


def test_tie_ranking_hangs_on_the_leader(spark):
    hits = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0 - 8e-6), (1, "0", 1.0 - 16e-6), (1, "b", 0.5)], "query_id long, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.tie_ranked(hits).orderBy("rank").collect()] == ["a", "b", "0"]


def test_rank_policies(spark):
    ranked = spark.createDataFrame([(1, f"c{i}", i, (i + 5) % 12) for i in range(12)], "query_id long, chunk_id string, position int, reranked int")
    order = [r.chunk_id for r in sorted(ranked.collect(), key=lambda r: r.reranked)]
    for f in range(10):
        at = order.index(f"c{f}")
        if at > f + 2:
            order.insert(f + 2, order.pop(at))
    assert [r.chunk_id for r in retrieval.cap_demotion(ranked, 2, "reranked").orderBy("capped").collect()] == order
    with pytest.raises(ValueError, match="bounds"):
        retrieval.check_request("x", k=51)
    prior = spark.createDataFrame([("what changed", "Guide > Change-log"), ("show the changelog", "changelog"), ("x", "unchangelogged")], "q string, p string")
    assert [r[0] for r in prior.select(retrieval.section_prior("q", "p", 0.25)).collect()] == [0.75, 1.0, 1.0]


def test_fusion_counts_a_chunk_once(spark):
    hits = spark.createDataFrame([(1, "dense", "a", 0), (1, "dense", "a", 1), (1, "dense", "b", 2), (1, "lexical", "b", 0)], "query_id long, route string, chunk_id string, position int")
    got = {r.chunk_id: r.score for r in retrieval.fuse(retrieval.first_hits(hits)).collect()}
    assert got == {"a": 1 / 61, "b": 1 / 62 + 1 / 61}


def test_spans_touch_and_overlap(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 1, 3), (2, 0, 1)], "revision_id long, start long, end long")
    assert {(r.revision_id, r.start, r.end, r.parts) for r in evidence.span_union(spans).collect()} == {(1, 0, 9, 3), (1, 10, 12, 1), (2, 0, 1, 1)}
    wide = spark.createDataFrame([(1, 0, 5000)], "revision_id long, l_start long, l_end long").withColumn("l_id", F.lit(1))
    many = spark.createDataFrame([(1, 7, 1000, 3000)], "revision_id long, r_id long, r_start long, r_end long")
    assert evidence.overlapping(wide, many, "revision_id").count() == 1


def test_mmr_brute_force(spark):
    random.seed(5)
    pool = [(1, f"c{i}", i, None, sorted({f"s{random.randint(0, 12)}" for _ in range(6)})) for i in range(15)]
    rest, out = list(pool), []
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    while len(out) < 6:
        best = min(rest, key=lambda x: (-round(0.7 / (x[2] + 1) - 0.3 * max([sim(x[4], y[4]) for y in out], default=0.0), 12), x[2]))
        rest.remove(best)
        out.append(best)
    frame = spark.createDataFrame(pool, "query_id long, chunk_id string, rank int, version string, shingles array<string>")
    assert [r.chunk_id for r in evidence.mmr_select(frame, 6).orderBy("selected").collect()] == [x[1] for x in out]


def test_table_facts_and_versions(spark):
    rows = spark.createDataFrame([("t1", "a", "1"), ("t1", "b", "only if set"), ("t2", "a", "2"), ("t3", "a", " "), ("t4", "x", "isn't so")], "t string, k string, v string")
    assert [r.t for r in evidence.table_facts(rows, "t", ["k", "v"]).collect()] == ["t2"]
    passages = spark.createDataFrame([(1, "f", "1.9"), (2, "f", "1.10"), (3, "g", None), (4, "g", "2"), (5, "h", "1")], "id long, fam string, version string")
    got = {r.id: (r.status, r.winner) for r in evidence.version_collapse(passages, ["fam"], "version", "id").collect()}
    assert got == {1: ("alternate", 2), 2: ("current", None), 3: ("undecided", None), 4: ("current", None), 5: ("current", None)}


def test_scopes_by_whole_segments(spark):
    rows = spark.createDataFrame([("a/b",), ("a/b/c",), ("a/bc",), ("a",), (None,)], "path string")
    grants = spark.createDataFrame([("a/b",)], "grant string")
    assert sorted(r.path for r in inventory.visible(rows, grants).collect()) == ["a/b", "a/b/c"]
    crossed = rows.crossJoin(grants).where(inventory.covers("grant", "path"))
    assert sorted(r.path for r in crossed.collect()) == ["a/b", "a/b/c"]


def test_latest_first_then_eligible(spark):
    revisions = spark.createDataFrame([(1, 1, "valid", "accepted"), (1, 2, "failed", None), (2, 1, "valid", None)], "document_id long, record_seq long, status string, disposition string")
    assert inventory.latest_eligible(revisions).count() == 0
    assert {(r.document_id, r.reason) for r in inventory.left_out(revisions).collect()} == {(1, "failed"), (2, "undecided")}


def test_inventory_refuses_too_many_groups(spark):
    rows = spark.range(1001).select(F.col("id").alias("document_id"), F.col("id").cast("string").alias("v"))
    assert inventory.inventory_groups(rows.where("document_id < 1000"), "v").count() == 1000
    with pytest.raises(ValueError, match="groups"):
        inventory.inventory_groups(rows, "v")


def test_text_metadata_is_text_only(spark):
    rows = spark.createDataFrame([('{"v": "1"}',), ('{"v": 1}',), ('{"w": "x"}',), ("no json",), (None,)], "m string")
    assert [r[0] for r in rows.select(inventory.text_metadata("m", "v")).collect()] == ["1", None, None, None, None]


@pytest.mark.parametrize("key", ["v.w", "it's", 'a "b"', """both ' and \" of [0]""", "é $", ""])
def test_text_metadata_of_any_key(spark, key):
    texts = [json.dumps({key: "x", "v": {"w": "no"}}), json.dumps({key: 1}), json.dumps([key]), "{}", "{", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, m string")
    assert [r[0] for r in rows.orderBy("i").select(inventory.text_metadata("m", key)).collect()] == ["x", None, None, None, None, None]


def test_literal_containment(spark):
    rows = spark.createDataFrame([("use v1.2.", "v1.2"), ("use v1.2.3", "v1.2"), ("x/a.conf", "a.conf"), ("(a.conf)", "a.conf")], "t string, a string")
    assert [r[0] for r in rows.select(inventory.has_literal("t", "a")).collect()] == [True, False, False, True]


def test_ndcg_groups_and_bootstrap(spark):
    expected = spark.createDataFrame([(1, 10, "g"), (1, 11, "g"), (1, 12, None), (2, 20, None)], "question_id long, item long, group string")
    ranked = spark.createDataFrame([(1, 11, 2), (1, 10, 3)], "question_id long, item long, rank int")
    got = {r.question_id: r for r in evaluation.question_metrics(evaluation.item_ranks(expected, ranked)).collect()}
    d = evaluation.DISCOUNTS
    assert abs(got[1].ndcg_10 - d[1] / (d[0] + d[1])) < 1e-12 and got[1].mrr_10 == 0.5 and got[2].ndcg_10 == 0.0
    values = [(i % 2, i, float(i % 5)) for i in range(20)]
    frame = spark.createDataFrame(values, "s int, o int, v double")
    row = evaluation.bootstrap_interval(frame, "v", "s", "o", 7, resamples=50).first()
    gamma, mask, state, means = 0x9E3779B97F4A7C15, (1 << 64) - 1, 7, []
    strata = [[v for s, _, v in values if s == k] for k in (0, 1)]
    for _ in range(50):
        total = 0.0
        for stratum in strata:
            for _ in stratum:
                state = (state + gamma) & mask
                z = state
                z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
                z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
                z ^= z >> 31
                total += stratum[z * len(stratum) >> 64]
        means.append(total / 20)
    means.sort()
    assert (row.low, row.high) == (means[-(-25 * 50 // 1000) - 1], means[-(-975 * 50 // 1000) - 1])


def test_runs_must_have_the_same_questions(spark):
    a = spark.createDataFrame([(1, 0.5)], "question_id long, m double")
    assert evaluation.paired(a, a, "m").first().difference == 0.0
    with pytest.raises(ValueError, match="differ"):
        evaluation.paired(a, a.withColumn("question_id", F.lit(2).cast("long")), "m")


def test_journal_and_cursors(spark):
    events = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "a")], "stream string, at int, type string")
    held = journal.sequenced(events, "stream", ["at"])
    assert {(r.stream, r.sequence) for r in held.collect()} == {("s", 1), ("s", 2), ("t", 1)}
    cursors = spark.createDataFrame([("c", "s", 1)], "consumer string, stream string, position long")
    assert [r.type for r in journal.read_after(held, cursors, "stream").collect()] == ["b"]
    for position, want in ((0, 1), (2, 2), (9, 1)):
        acks = spark.createDataFrame([("c", "s", position)], "consumer string, stream string, position long")
        assert journal.acknowledge(cursors, acks, held, "stream").first().position == want
    jobs = spark.createDataFrame([("j", 1, "running"), ("j", 2, "running"), ("j", 3, "succeeded"), ("j", 4, "queued")], "key string, at int, state string")
    assert tuple(journal.fold_states(jobs, "key", "at", "state", "queued", journal.JOB_STEPS).first()) == ("j", "succeeded", 2, 2)
    assert json.loads(journal.envelopes(held, "stream", "type", "at").orderBy("id").first().envelope)["sequence"] == 1


def test_stream_gives_the_batch_result(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = stream.where("value > 0").select("event_id", "event_type")
    out = journal.drain(spark, kept, str(tmp_path / "out"), str(tmp_path / "check"))
    again = journal.drain(spark, kept, str(tmp_path / "out"), str(tmp_path / "check"))
    assert out.count() == again.count() == source.where("value > 0").count()
    query = journal.windowed(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.window_start, r.event_type, r.events)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, journal.windowed(source, "ts", "event_type", "value").collect()))


def test_manifest_and_files(spark, tmp_path):
    good = {"path": "a.md", "sha256": hashlib.sha256("é".encode()).hexdigest(), "bytes": 2, "source_ref": "r", "title": "t", "source_kind": "k"}
    lines = [json.dumps(good), "", json.dumps({**good, "path": "b.md"}), json.dumps({**good, "path": "c.md", "bytes": 3}), "[1]", json.dumps({**good, "odd": 1}), json.dumps({**good, "title": None})]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.md").write_text("é")
    (files / "c.md").write_text("é")
    entries, refusals = corpus.manifest(spark, str(tmp_path / "m.jsonl"))
    assert {r.line: r.reason for r in refusals.collect()} == {5: "not an object", 6: "an unknown field", 7: "missing: title"}
    assert {r.path: r.state for r in corpus.verified(entries, str(files)).collect()} == {"a.md": "imported", "b.md": "missing", "c.md": "size"}


def test_manifest_lines_over_splits(spark, tmp_path):
    good = {"path": "a.md", "sha256": "0" * 64, "bytes": 2, "source_ref": "r", "title": "t", "source_kind": "k"}
    lines = ["" if k % 7 == 0 else "[]" if k % 11 == 0 else json.dumps({**good, "path": f"{k}.md"}) for k in range(1, 2001)]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        entries, refusals = corpus.manifest(spark, str(tmp_path / "m.jsonl"))
        assert {(r.line, r.path) for r in entries.collect()} == {(k, f"{k}.md") for k, x in enumerate(lines, 1) if x.startswith("{")}
        assert {r.line for r in refusals.collect()} == {k for k, x in enumerate(lines, 1) if x == "[]"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_points_are_written_again_without_harm(spark, tmp_path):
    path = str(tmp_path / "points")
    points = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "point_id long, payload string")
    for generation in ("g1", "g2", "g1"):
        corpus.write_points(points, path, generation)
    assert sorted((r.generation, r.point_id, r.payload) for r in spark.read.parquet(path).collect()) == [("g1", 1, "a"), ("g1", 2, "b"), ("g2", 1, "a"), ("g2", 2, "b")]


def test_dense_of_odd_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0]), (5, None), (6, [3.0, 0.0]), (7, [-1.0, 0.0])], "id long, vector array<float>")
    queries = spark.createDataFrame([("q", [2.0, 0.0]), ("z", [0.0, 0.0]), ("one", [5.0]), ("none", None)], "query_id string, vector array<float>")
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in retrieval.dense_topk(vectors, queries, 3).collect())
    assert got == [("one", 1, 4, 1.0), ("q", 1, 1, 1.0), ("q", 2, 6, 1.0), ("q", 3, 2, 0.0)]


def test_upsert_and_artifacts(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert {tuple(r) for r in corpus.upsert(held, fresh, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in corpus.upsert(held, fresh, ["k"], replace=False).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    contents = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    assert corpus.put_artifacts(contents).count() == 2


def test_mmr_units_and_budget(spark):

    random.seed(3)
    pools = {}
    for q in range(12):
        n = random.randint(1, 14)
        unit = lambda: random.choice([None, None, "u1", "u2"])
        pools[q] = [(q, f"c{q}-{r}", r, random.choice(["v1", "v2"]), [random.randint(0, 12) for _ in range(6)], unit(), random.randint(1, 40)) for r in range(n)]
        pools[q] = [(*c[:4], sorted(set(c[4])), *c[5:]) for c in pools[q]]

    def brute(pool, k, most):
        sim = lambda a, b: 0 if a[3] != b[3] or not set(a[4]) & set(b[4]) else len(set(a[4]) & set(b[4])) / len(set(a[4]) | set(b[4]))
        units = {}
        for i, c in enumerate(pool):
            units.setdefault(c[5] or f"own {i}", []).append(i)
        pending, chosen, used = set(range(len(pool))), [], 0
        while pending and len(chosen) < k:
            best = min(pending, key=lambda i: (-round(0.7 / (pool[i][2] + 1) - 0.3 * max((sim(pool[i], pool[j]) for j in chosen), default=0), 12), pool[i][2]))
            unit = next(u for u in units.values() if best in u)
            pending -= set(unit)
            size = sum(pool[i][6] for i in unit)
            if len(chosen) + len(unit) <= k and used + size <= most:
                chosen += unit
                used += size
        return [pool[i][1] for i in chosen]

    frame = spark.createDataFrame([c for pool in pools.values() for c in pool], "query_id long, chunk_id string, rank int, version string, shingles array<long>, unit string, bytes long")
    for k, most in ((5, 90), (3, 1000), (20, 60)):
        got = {}
        for r in sorted(evidence.mmr_select(frame, k, most_bytes=most).collect(), key=lambda r: (r.query_id, r.selected)):
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == {q: want for q, pool in pools.items() if (want := brute(pool, k, most))}


def test_fold_of_states_in_blocks(spark):
    from stratum.streaming import journal

    names = ["running", "queued", "succeeded", "failed", "cancelled"]
    rows = [(k, n, names[(n * 7 + k) % 5]) for k in range(4) for n in range(60)]
    frame = spark.createDataFrame(rows, "job long, n long, state string")
    whole = sorted(map(tuple, journal.fold_states(frame, "job", "n", "state", "queued", journal.JOB_STEPS).collect()))
    assert whole == sorted(map(tuple, journal.fold_states(frame, "job", "n", "state", "queued", journal.JOB_STEPS, block=7).collect()))


def test_conflict_units_are_transitive(spark):
    from stratum.operators.evidence import conflict_units

    rows = [(1, "g1", "c"), (1, "g1", "b"), (1, "g2", "b"), (1, "g2", "a"), (1, "g3", "z"), (2, "g1", "c")]
    got = {tuple(r) for r in conflict_units(spark.createDataFrame(rows, "query_id long, group string, chunk_id string")).collect()}
    assert got == {(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "z", "z"), (2, "c", "c")}


def test_minhash_recall_and_signatures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    found = {tuple(r)[:2] for r in dedup.candidate_pairs(dedup.minhash_signatures(docs, "doc_id", "text")).collect()}
    wanted = {tuple(r)[:2] for r in dedup.confirmed_pairs(docs, "doc_id", "text").collect()}
    assert wanted and len(found & wanted) >= 0.95 * len(wanted)
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def signature(text):
        words = text.encode().split()
        hashes = set()
        for i in range(max(1, len(words) - 4)):
            h = 0xCBF29CE484222325
            for byte in b"\xff".join(words[i : i + 5]) + b"\xff":
                h = (h ^ byte) * 0x100000001B3 & mask
            hashes.add(h)
        return [min(mix(h ^ mix(s)) for h in hashes) for s in range(1, 129)]

    texts = ["a b", "one two three four five six é seven", "x " * 12]
    rows = dedup.minhash_signatures(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()
    assert [[v & mask for v in r.signature] for r in sorted(rows, key=lambda r: r.id)] == [signature(t) for t in texts]
