"""Filter interaction audit: five filters, every order of them, counted for each part of a corpus.

Duplicates are found by sorting. Rows are dealt by ranges of (SHA-256 of the text, doc_id) and sorted inside a range
by digest, whole text and doc_id, so copies stand together, the smallest id first; each row is compared with the one
before it. A range may begin amid a group of copies, however large: rows of a range's first group also carry the
group's digest, and each range says which id its last group began with. These edges, one a range, settle them.

Each row ends as a mask of the filters that it fails. Masks are merged into counters for each part, which add up;
what every order of the filters removes, loses and keeps follows from at most 32 counters a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import map_arrow, settle
from stratum.sources.tables import table

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 3
MARKUP = "#$%&*|"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DUPLICATE = 16
_MASKS = "doc_id long, part string, mask int, edge binary"


def text_mask(text: bytes) -> int:
    """Which of the filters A to D the text fails, as bits 0 to 3."""
    words = text.split()
    n_upper = len(text) - len(text.translate(None, _UPPER))
    n_chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT_PERCENT * len(words)) << 1
        | (100 * n_upper > MOST_UPPER_PERCENT * n_chars) << 2
        | (len(text.translate(None, MARKUP.encode())) < len(text)) << 3
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range: each row's mask, with its group's digest where the group may begin in an earlier range; at last a
    row without a mask, of the last group's digest and first id."""
    digest, held, first, mask, opening = None, None, None, 0, True
    for part, texts in blocks(batches, "text"):
        masks, edges = [], []
        ids = part.column(0).to_pylist()
        for doc_id, text, now in zip(ids, texts, part.column(3).to_pylist(), strict=True):
            if now != digest or text != held:
                opening = digest is None
                digest, held, first = now, text, doc_id
                mask = text_mask(text)
            masks.append(mask | _DUPLICATE * (doc_id is not None and first < doc_id))
            edges.append(now if opening else None)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(masks, pa.int32()), pa.array(edges, pa.binary())], ["doc_id", "part", "mask", "edge"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([digest], pa.binary())], ["doc_id", "part", "mask", "edge"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: bit k is set if it fails filter ``FILTERS[k]``.

    A null text is empty, a null part the empty string. E: another row has the same text and a smaller id. A null id is
    smaller than none and has none that is smaller; rows alike in id and text do not fail each other.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    last = F.col("doc_id").asc_nulls_last()
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = settle(map_arrow(rows.repartitionByRange(parallel, "digest", last).sortWithinPartitions("digest", "text", last), _scan, _MASKS), "masks")
    # One edge a range at most, whatever the rows: small enough to send. A group's first id is the smallest of its ranges'.
    edges = scanned.where("mask IS NULL").groupBy("edge").agg(F.min("doc_id").alias("first"))
    failing = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    settled = scanned.where("mask IS NOT NULL").join(F.broadcast(edges), "edge", "left")
    return settled.select("doc_id", "part", F.when(failing, F.col("mask").bitwiseOR(_DUPLICATE)).otherwise(F.col("mask")).alias("mask"))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counters. Of repeated labels any quality=1 or toxic=1 counts."""
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic")
    )
    # Rows of one id are merged before the join, so an id with very many rows brings few.
    each = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(marked, "doc_id", "left")
    lost = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))


def audit(counters: DataFrame) -> DataFrame:
    """A row for each part, order of all filters and step, from (part, mask, n, good, toxic).

    kept: rows that pass this step's filter and all before; removed: those that fail it first; redundant: those that fail
    it and one before; unique_fails: those that fail it alone; good_lost, toxic_lost: of the removed, those so labelled;
    shapley: what the filter removes, summed over all orders. No rows, no parts.
    """
    spark = counters.sparkSession
    fields = ("kept", "removed", "redundant", "unique_fails", "share")
    # What one row of a mask adds at each step: 32 masks x 600 steps, whatever the corpus.
    plan = spark.createDataFrame(_plan(), f"mask int, filter_order string, step int, {', '.join(f'{f} int' for f in fields)}")
    both = counters.join(F.broadcast(plan), "mask")
    total = lambda flag, what="n": F.sum(F.col(what) * F.col(flag))
    return both.groupBy("part", "filter_order", "step").agg(
        *(total(f).alias(f) for f in fields[:4]), total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("share").alias("shapley")
    )


def _plan() -> list[tuple[int, str, int, int, int, int, int, int]]:
    """(mask, order, step, kept, removed, redundant, unique_fails, share). share: in how many orders the step's filter
    removes such a row; of the filters that it fails, each comes first in as many orders as the others."""
    orders = ["".join(x) for x in permutations(FILTERS)]
    out = []
    for mask in range(1 << len(FILTERS)):
        for order in orders:
            passed = True
            for k, letter in enumerate(order):
                bit = 1 << FILTERS.index(letter)
                fails = bool(mask & bit)
                out.append((mask, order, k + 1, int(passed and not fails), int(passed and fails), int(fails and not passed), int(mask == bit), len(orders) // mask.bit_count() if fails else 0))
                passed = passed and not fails
    return out


_SQL_STEPS = ", ".join(f"('{order}', {k + 1}, {1 << FILTERS.index(order[k])}, {sum(1 << FILTERS.index(x) for x in order[:k])})" for order in map("".join, permutations(FILTERS)) for k in range(len(order)))
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x) > 0) AS words,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS copy FROM t),
m AS (SELECT doc_id, part, CAST(len(words) < {LEAST_WORDS} AS INT) + 2 * CAST(100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) AS INT)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER_PERCENT} * length(text) AS INT)
    + 8 * CAST(length(translate(text, '{MARKUP}', '')) < length(text) AS INT) + 16 * CAST(copy AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
s(filter_order, step, bit, before) AS (VALUES {_SQL_STEPS})
SELECT part, filter_order, step, CAST(sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
    CAST(sum(CASE WHEN mask & bit <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM c, s GROUP BY part, filter_order, step
"""


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(part_counters(failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))
