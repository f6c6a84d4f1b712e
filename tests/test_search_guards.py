"""The expansion guard and identifier spans by examples and against plain rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratum.functions import intent_guard
from stratum.functions.identifiers import FAMILIES
from stratum.operators import blocks
from stratum.operators import identifier_spans as spans

GUARDED = [
    ("what happens only after the third step", "only after third step it ends", "kw", "accepted"),
    ("only after the 3rd step", "Only AFTER a three step", "kw", "accepted"),
    ("only after the step", "after the step only", "kw", "protected_missing"),
    ("not 'ok'", "is ok", "kw", "protected_missing"),
    ("no notification", "a notification", "kw", "protected_missing"),
    ("use it", "use 5 of it", "k", "added_number"),
    ("use it", "use it", "five", "added_number"),
    ("step 007", "step seven", "k", "accepted"),
    ("don’t run", "don't run", "k", "accepted"),
    ("go on after", "it is after", "k", "accepted"),
    ("jusqu'à la fin", "jusqu'à fin", "k", "accepted"),
    ("a", "", "y", "empty"),
    ("a", "x", " \n", "empty"),
    (None, None, None, "empty"),
    ("x", "x " + "y" * 2048, "k", "oversize"),
    ("x", "x", "y" * 513, "oversize"),
    ("run 2.4.1 now", "run 2 4 1 now", "k", "identifier_missing"),
    ("use --force", "use it", "k", "identifier_missing"),
    ("use it", "use --force", "k", "identifier_added"),
    ("error E42 it", "error E42 it", "k", "accepted"),
]


def test_guard(spark):
    rows = spark.createDataFrame(GUARDED, "q string, p string, k string, want string")
    got = rows.withColumn("got", F.expr(intent_guard.verdict("q", "p", "k"))).collect()
    assert [(r.q, r.got) for r in got] == [(r.q, r.want) for r in got]


def standing(text):
    taken = []
    for f, a, b in sorted(spans.candidates(text), key=lambda c: (FAMILIES.index(c[0]), c[1], c[2])):
        if all(b <= x or y <= a for _, x, y in taken):
            taken.append((f, a, b))
    return [(f, text[a:b]) for f, a, b in sorted(taken, key=lambda c: c[1])]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Run `runner --quiet` now", [("command", "runner --quiet")]),
        ("``a ` b`` and `c", [("command", "a ` b")]),
        ("tool run --force --quiet", [("command", "tool run --force --quiet")]),
        ("tool_v2 run-2 --force", [("command", "tool_v2 run-2 --force")]),
        ("tool run --force, --quiet", [("command", "tool run --force"), ("parameter", "--quiet")]),
        ("tool run", []),
        ("Tool --force", [("parameter", "--force")]),
        ("tool 2run --force", [("parameter", "--force")]),
        ("tool run! --force", [("parameter", "--force")]),
        ("how do i use the tool with --force", [("parameter", "--force")]),
        ("comment lancer l'outil avec --force", [("parameter", "--force")]),
        ("How do I force a rerun with ctm run --force?", [("command", "ctm run --force")]),
        ("see /etc/app.conf, v1.2.3 on port 8080: ERR-404", [("path", "/etc/app.conf"), ("version", "v1.2.3"), ("port", "8080"), ("error_code", "ERR-404")]),
        ("tool\n--force", [("parameter", "--force")]),
    ],
)
def test_spans(text, want):
    assert standing(text) == want


def test_arbitration_of_long_texts(spark):
    rng = random.Random(1)
    bits = ["tool", "run", "--force", "-x", "`a b`", "`", "/etc/x.conf", "v1.2", "port 80", "E404", "the", "é", ",", "\n"]
    docs = [(i, " ".join(rng.choices(bits, k=rng.choice((0, 5, 60, 900))))) for i in range(60)] + [(99, None), (None, "tool --x")]
    found = blocks.arbitrate(spans.spans(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id").collect()
    got = {}
    for r in sorted(found, key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append((r.family, r.value))
    assert got == {i: standing(t) for i, t in docs if i is not None and t and standing(t)}
