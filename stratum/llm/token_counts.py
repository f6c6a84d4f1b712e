"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. A byte-level token stands for a known number of bytes, so the
running sum of these gives each token's span. Sections are half-open byte spans that cover the text:
its lines, each with the line break that ends it, or those that begin at characters which a column
gives, or a document's fields (``field_tokens``). A binary search of the tokens' spans among the
sections' bounds is the interval join.

Rule for a token that crosses a boundary (``rule``): ``first``: it counts for the section of its first
byte; ``most``: for the section that holds most of its bytes, of equals the earlier. Either way each
token counts for exactly one section, so sections' counts add up to the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.bpe import WordEncoder, default_tokenizer
from stratum.llm.common import blocks
from stratum.runtime import map_arrow
from stratum.sources.tables import table

RULE = "most"
_FIELDS = "doc_id long, section int, begin_byte long, end_byte long, begin_char long, end_char long, n_tokens long, n_crossing long, doc_tokens long"


def line_bounds(text: bytes) -> np.ndarray:
    """Bounds of the lines of a text; an empty text is one empty section."""
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    inner = breaks[breaks < len(text)]
    return np.concatenate([[0], inner, [len(text)]])


def given_bounds(text: bytes, begins: list[int] | None) -> np.ndarray:
    """Bounds of the sections that begin at the given characters. The text's start is always one; repeats and places outside the text count for nothing."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    inner = sorted({b for b in begins or () if b is not None and 0 < b < len(starts)})
    return np.concatenate([[0], starts[inner], [len(text)]]).astype(np.int64)


def attribute(bounds: np.ndarray, sizes: np.ndarray, rule: str = RULE) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross its bounds. sizes: bytes of each token."""
    n = len(bounds) - 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    inner = bounds[1:-1]
    first = np.searchsorted(inner, begins, "right")
    last = np.searchsorted(inner, np.maximum(ends - 1, begins), "right")
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "most":
        for t in crossing.tolist():
            edges = np.concatenate([[begins[t]], inner[first[t] : last[t]], [ends[t]]])
            owner[t] = first[t] + int(np.argmax(np.diff(edges)))
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, rule: str = RULE, begins_col: str | None = None) -> DataFrame:
    """A row for each section of each document: its span in bytes and characters, tokens, crossing tokens and the document's tokens.

    begins_col: a column array<int> or array<long> of the characters at which sections begin; without one, lines
    are sections. Null texts count as empty; an empty text has one section of no tokens. Repeated rows each give
    their sections. No rows give none. Only the named columns are read.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(path)
        table_sizes = encoder.token_sizes()
        for part, texts in blocks(batches, "text"):
            begins = part.column(2).to_pylist() if begins_col else None
            columns: list[list[np.ndarray]] = [[] for _ in range(8)]
            repeats = []
            stream, many = encoder.encode(texts)
            for k, (text, sizes) in enumerate(zip(texts, np.split(table_sizes[stream], np.cumsum(many)[:-1]), strict=True)):
                if sizes.sum() != len(text):
                    raise ValueError("the tokens' bytes don't cover the text")
                bounds = given_bounds(text, begins[k]) if begins else line_bounds(text)
                counts, crossing = attribute(bounds, sizes, rule)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[bounds]
                n = len(counts)
                repeats.append(n)
                for column, x in zip(columns, (np.arange(n, dtype=np.int32), bounds[:-1], bounds[1:], chars[:-1], chars[1:], counts, crossing, np.full(n, len(sizes))), strict=True):
                    column.append(x)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(repeats)), repeats)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c)) for c in columns)], [f.split()[0] for f in _FIELDS.split(", ")])

    given = [F.col(begins_col).cast("array<long>").alias("begins")] if begins_col else []
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *given)
    return map_arrow(chosen, run, _FIELDS)


def field_tokens(docs: DataFrame, fields: list[str], id_col: str = "doc_id", separator: str = "\n", tokenizer: str | None = None, rule: str = RULE) -> DataFrame:
    """As ``section_tokens``, of documents made up of several columns: section k is field k with the separator after it.

    The fields are encoded as one text, so that tokens may cross them. Null fields count as empty. Empty fields with an
    empty separator have no place of their own and give no row.
    """
    parts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(separator if k < len(fields) - 1 else "")) for k, f in enumerate(fields)]
    sizes = F.array(*(F.length(p).cast("long") for p in parts[:-1])).cast("array<long>")
    begins = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0).cast("long"), lambda a, x: a + x)) if len(fields) > 1 else sizes
    whole = docs.select(F.col(id_col).alias("doc_id"), F.concat(*parts).alias("text"), begins.alias("begins"))
    return section_tokens(whole, "doc_id", "text", tokenizer, rule, "begins")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))
