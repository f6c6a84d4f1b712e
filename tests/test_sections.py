"""Sections that hold a span, against every section tried."""

from __future__ import annotations

import random

import pytest

from stratum.operators import evidence


@pytest.mark.parametrize("width", [1, 16, 4096])
def test_deepest_section_in_bins(spark, width):
    rng = random.Random(width)
    sections, spans = [], []
    for d in range(4):
        for i in range(40):
            a, b = sorted((rng.randrange(300), rng.randrange(300)))
            sections.append((d, f"{d}-{i}", a, b))
        spans += [(d, len(spans) + i, a, a + rng.choice([0, 0, 3, 40])) for i, a in enumerate(rng.choices(range(300), k=30))]
    # An empty span at a section's very end, a document without sections, a section that ends before it begins, and bounds that aren't there.
    sections += [(9, "end", 10, 16), (9, "wrong", 20, 12), (9, "none", None, 30)]
    spans += [(9, 9001, 16, 16), (9, 9002, 16, 17), (8, 9003, 1, 2), (None, 9004, 1, 2)]
    got = evidence.deepest_section(
        spark.createDataFrame(spans, "document_id int, span_id int, start long, end long"), spark.createDataFrame(sections, "document_id int, section_id string, section_start long, section_end long"), width=width
    )
    want = {}
    for d, k, a, b in spans:
        held = [(-x, y, s) for e, s, x, y in sections if e == d and d is not None and x is not None and x <= a and b <= y]
        want[k] = min(held)[2] if held else None
    assert {r.span_id: r.section_id for r in got.collect()} == want
