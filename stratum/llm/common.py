"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python worker works on at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: A key with more than one row in so many is hot; at most that many keys can be.
HOT_SHARE = 256
HOT_LEAST = 256


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``most`` bytes of text and ``rows`` rows, or a single row, and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most or i - start >= rows):
                part = batch.slice(start, i - start)
                yield part, texts_of(part.column(batch.schema.get_field_index(text)))
                start, held = i, 0
            held += int(size)
        part = batch.slice(start)
        yield part, texts_of(part.column(batch.schema.get_field_index(text)))


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Of one row for each key with its count: the keys with over 1/HOT_SHARE of all rows, at most HOT_SHARE of them."""
    total = counts.agg(F.sum(n).alias("__total"))
    return counts.join(F.broadcast(total), F.col(n) * HOT_SHARE > F.col("__total")).where(F.col(n) > 1).select(key)


def join_to_one(facts: DataFrame, dims: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Left join to one row a key. The few hot keys, whose number is bounded, are joined by broadcast, so no task gets a hot key's rows."""
    hot_dims = F.broadcast(dims.join(F.broadcast(hot), key, "left_semi"))
    return facts.join(F.broadcast(hot), key, "left_semi").join(hot_dims, key, "left").unionByName(facts.join(F.broadcast(hot), key, "left_anti").join(dims, key, "left"))


def looked_up(facts: DataFrame, key: str, dims: DataFrame, dim_key: str) -> DataFrame:
    """``facts``, a written table, with what ``dims`` has for its ``key``, null where it has none.

    Keys of more than one in HOT_SHARE rows, and of HOT_LEAST at least, are fewer than HOT_SHARE. They are asked for
    first, and their facts are joined by broadcast, so no task gets a hot key's rows. Mostly there are none.
    """
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[key] for r in counts.where(F.col("n") > max(HOT_LEAST, facts.count() // HOT_SHARE)).select(key).limit(HOT_SHARE).collect()]
    named = dims.withColumnRenamed(dim_key, key)
    if not hot:
        return facts.join(named, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return facts.where(is_hot).join(F.broadcast(named.where(is_hot)), key, "left").unionByName(facts.where(~is_hot).join(named.where(~is_hot), key, "left"))
