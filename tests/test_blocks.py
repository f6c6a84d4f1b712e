"""Blocks, identities, arbitration and answer support."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratum.operators import blocks

TEXT = "---\ntitle: é\n---\n# Head one #\n\npara é\nmore\n\n- item\n  goes on\n- two\n\n```py\n# no heading\n\nx\n```\n| a | b |\n|---|---|\n| 1 |\n\n> quote\n> more\n\n***\n## Sub\n"


def test_blocks(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id long, text string")
    rows = blocks.blocks(docs, "id", "text").orderBy("position").collect()
    kinds = [(r.kind, r.level) for r in rows]
    assert kinds == [("metadata", 0), ("heading", 1), ("paragraph", 0), ("list_item", 0), ("list_item", 0), ("code", 0), ("table_row", 0), ("table_row", 0), ("table_row", 0), ("block_quote", 0), ("thematic_break", 0), ("heading", 2)]
    raw = TEXT.encode()
    assert rows[1].text == "Head one" and raw[rows[2].start : rows[2].end].decode() == "para é\nmore\n" and "# no heading" in rows[5].text
    assert all(a.end <= b.start for a, b in zip(rows, rows[1:], strict=False)) and not b"".join(raw[a.end : b.start] for a, b in zip(rows, rows[1:], strict=False)).strip()
    parsed = blocks.blocks(docs, "id", "text")
    assert [tuple(r)[::2] for r in blocks.incomplete_tables(parsed).collect()] == [(1, 3)]
    sums = {r.document_id: (r.bytes, r.in_blocks + r.between, r.valid) for r in blocks.byte_accounting(parsed, docs, "id").collect()}
    assert sums == {1: (len(raw), len(raw), True), 2: (0, 0, True), 3: (0, 0, True)}
    assert not blocks.byte_accounting(parsed.where("position <> 2"), docs.where("id = 1"), "id").first().valid


def test_lines_end_at_line_feeds_and_carriage_returns_only():
    assert [b[2] for b in blocks.parse_blocks("a\x0cb\u0085c\u2028d\n\ne\rf\r\n\r\ng")] == ["a\x0cb\u0085c\u2028d", "e\nf", "g"]


def test_chrome_rules(spark):
    rows = [("heading", "Setup Link copied to clipboard"), ("paragraph", "Closed"), ("html", "<!-- image -->"), ("paragraph", "Closed"), ("paragraph", "run it Copy Copied to clipboard"), ("paragraph", "Copy Copied to clipboard"), ("html", "<a id='x'></a> <BR/>"), ("html", "<b>kept</b>"), ("list_item", "Closed"), ("paragraph", " Copy Copied to clipboard")]
    parsed = spark.createDataFrame([(1, p, k, t) for p, (k, t) in enumerate(rows)], "document_id long, position int, kind string, text string")
    got = [(r.rule, r.kept) for r in blocks.indexed_blocks(parsed).orderBy("position").collect()]
    assert got == [("heading_suffix", "Setup"), ("label_before_image", None), ("markup", None), (None, "Closed"), ("paragraph_suffix", "run it"), ("label", None), ("markup", None), (None, "<b>kept</b>"), (None, "Closed"), ("paragraph_suffix", None)]


def test_duplicates_need_both_digests(spark):
    docs = spark.createDataFrame([(1, "# a\n"), (2, "# a\n"), (3, "#  a\n"), (4, None)], "document_id long, text string")
    digests = blocks.comparison_digest(blocks.blocks(docs, "document_id", "text"))
    assert len({r.digest for r in digests.collect()}) == 1
    assert {tuple(r) for r in blocks.exact_duplicates(docs, digests).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}


def test_identities(spark):
    names = spark.createDataFrame([("chunk-é",), ("b",)], "n string")
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert all(r.u == str(uuid.uuid5(uuid.UUID(space), r.n)) for r in names.select("n", F.expr(blocks.point_id("n", space)).alias("u")).collect())
    found = spark.createDataFrame([(1, "c", "m"), (1, "c", "m"), (2, "c", "m")], "id long, code string, message string")
    assert {tuple(r) for r in blocks.finding_rollup(found, "id").collect()} == {(1, "c", "m (2 times)"), (2, "c", "m")}
    revisions = spark.createDataFrame([("k", 2), ("k", 1)], "collection string, revision_id long")
    one, two = (blocks.chunk_set_identity(r, ["collection"], "p", "c").first().chunk_set for r in (revisions, revisions.orderBy("revision_id")))
    assert one == two


def test_arbitration_and_support(spark):
    rows = [(1, 2, 0, 5, "version", "1.2.3"), (1, 1, 3, 9, "path", "x"), (1, 4, 10, 12, "error", "E1"), (2, 5, 0, 1, "p", "y")]
    got = {tuple(r)[:2] for r in blocks.arbitrate(spark.createDataFrame(rows, "id long, priority int, start long, end long, family string, value string")).collect()}
    assert got == {(1, "path"), (1, "error"), (2, "p")}
    answers = [(1, "q", "run it with --fast twice 3 [1]"), (2, "q", "run it three times [2]"), (3, "q", "run it now please"), (4, "q", "run it with --slow please [1]"), (5, "q", "no [1]"), (6, "q", "it takes 13 of them [1]"), (7, "q", "run `make all` now please [1]")]
    passages = [(i, 1, "use --fast for 3 runs") for i in range(1, 8)]
    out = {r.question_id: r.reason for r in blocks.supported(spark.createDataFrame(answers, "question_id long, question string, answer string"), spark.createDataFrame(passages, "question_id long, n int, text string")).collect()}
    assert out == {1: None, 2: "a citation of no passage", 3: "no citation", 4: "a literal without support", 5: "too short", 6: "a literal without support", 7: "a literal without support"}
