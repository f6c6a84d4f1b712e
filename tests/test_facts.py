"""Table facts and protected facts of parsed documents."""

from __future__ import annotations

from stratum.operators import documents, evidence, facts

TABLES = """| Entity | ATTRIBUTE | value |
|---|---|---|
| a | b | `c` |
| d | e | f |

| Parameter | Default |
|---|---|
| timeout | 30 |

- | Parameter | Default |
  |---|---|
  | x | |

| Parameter | Default |
|---|---|
| x | only 3 |

| Parameter | Default |
|---|---|
| x | ne pas |

| Parameter | Default |
|---|---|
| short |

| Parameter | Default | |
|---|---|---|
| x | 1 | |

> | Parameter | Default |
> |---|---|
> | deep | er |
"""


def test_table_facts(spark):
    docs = spark.createDataFrame([(1, TABLES), (2, "no table"), (3, None)], "doc_id long, text string")
    got = facts.table_facts(documents.block_tree(docs)).orderBy("table", "row").collect()
    assert [(r.document_id, r.row, r.entity, r.attribute, r.value) for r in got] == [(1, 0, "a", "b", "`c`"), (1, 1, "d", "e", "f"), (1, 0, "timeout", "default", "30"), (1, 0, "deep", "default", "er")]


def test_signatures_keep_what_must_differ(spark):
    rows = [
        (1, 1, "paragraph", "set it to 5 now"), (2, 1, "paragraph", "put it at 5 then"), (3, 1, "paragraph", "set it to 6 now"),
        (4, 1, "paragraph", "run `a b`"), (5, 1, "paragraph", "run `a c`"), (6, 1, "code", "x"), (7, 1, "code", "y"),
        (8, 1, "paragraph", "do it"), (9, 1, "paragraph", "leave it"), (10, 1, "paragraph", "do not"), (11, 1, "paragraph", "don't"),
        (12, 1, "paragraph", "1"), (12, 2, "paragraph", "2"), (13, 2, "paragraph", "1"), (13, 1, "paragraph", "2"),
    ]
    got = {r.k: r.signature for r in facts.signatures(spark.createDataFrame(rows, "k int, node int, kind string, text string"), ["k"]).collect()}
    assert got[1] == got[2] and got[8] == got[9]
    assert len({got[k] for k in (1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13)}) == 11


def test_selection_reads_signatures(spark):
    rows = [("q", str(i), i, None, [1, 2, 3], s) for i, s in enumerate(("x", "x", "y"))]
    frame = spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, version string, shingles array<long>, signature string")
    # The second repeats the first; the third says another thing in the same words, so it comes before it.
    assert [r.chunk_id for r in evidence.mmr_select(frame, 3).orderBy("selected").collect()] == ["0", "2", "1"]
