"""Identifiers of whole texts with their places: every family's candidates, for ``blocks.arbitrate`` to choose from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.identifiers import _PATTERNS, FAMILIES
from stratum.functions.text import ENGLISH, FRENCH
from stratum.runtime import map_arrow, spread

# The border after a match is looked at, not taken, so that it can be the next one's border before.
_COMPILED = {f: regex.compile(")(?=".join(p.rsplit(")(?:", 1))) for f, p in _PATTERNS.items() if f != "command"}
_WORD = re.compile(r"[a-z0-9_-]+\Z")
_STOP = frozenset((*ENGLISH, *FRENCH))


def code_spans(text: str) -> list[tuple[int, int]]:
    """What stands between two runs of as many back quotes, from the left; a run without a partner ends the search."""
    runs = [m.span() for m in re.finditer("`+", text)]
    out, k = [], 0
    while k < len(runs):
        size = runs[k][1] - runs[k][0]
        close = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == size), None)
        if close is None:
            break
        out.append((runs[k][1], runs[close][0]))
        k = close + 1
    return out


def commands(text: str, parameters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Lower-case words that lead to a parameter, each with the words and parameters after it; no stopword may be among them."""
    out = []
    for k, (start, end) in enumerate(parameters):
        for begin, upto in parameters[k + 1 :]:
            if text[end:begin].strip() or begin <= end:
                break
            end = upto
        at = start
        while at and text[at - 1].isspace():
            gap = at
            while gap and text[gap - 1].isspace():
                gap -= 1
            if at == start and text[at - 1] != " ":
                break
            found = _WORD.search(text, max(0, gap - 200), gap)
            if not found or not "a" <= found[0][0] <= "z" or found[0] in _STOP:
                break
            word = found.start()
            if word and (text[word - 1].isalnum() or text[word - 1] == "_"):
                break
            if text[gap] == " ":
                out.append((word, end))
            if not (word and text[word - 1].isspace()):
                break
            at = word
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(family, start, end) in characters, before arbitration."""
    out = []
    for family, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            start, end = m.span(1)
            if family == "path":
                end = start + len(text[start:end].rstrip(",.;!?)]}"))
            if end > start and (family != "port" or 1 <= int(m[1]) <= 65535):
                out.append((family, start, end))
    parameters = sorted((s, e) for f, s, e in out if f == "parameter")
    return out + [("command", s, e) for s, e in code_spans(text) + commands(text, parameters)]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, family, priority, start, end, value) of every candidate in every text; null and blank texts and ids have none."""
    names = ["doc_id", "family", "priority", "start", "end", "value"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f, FAMILIES.index(f), a, b, t[a:b]) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for f, a, b in candidates(t)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    chosen = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_arrow(spread(chosen), run, "doc_id long, family string, priority int, start long, end long, value string")
