"""Numbers of sorted rows, and lookups of hot keys, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.runtime import settle

#: A key of over one row in so many is hot, and of so many rows at least: there are fewer than HOT_SHARE.
HOT_SHARE, HOT_LEAST = 256, 4096


def numbered(rows: DataFrame, order: list[str], name: str, by: str | None = None) -> DataFrame:
    """Adds ``name``: the row's place from 0 in ``order`` among all rows, or among those with its ``by``; nulls first and a group too, equal rows in any order.

    Rows are dealt into sorted ranges and written with their range, so that a lost task can't deal them again in another way.
    A row's number is its place in its range and its group's rows in the ranges before; a range has at most one group that
    began before it, so these are a row a range.
    """
    keys = [] if by is None else [by]
    ranged = settle(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__n")).where("__before > 0")
    held = before.select(F.col("__range").alias("__r"), *(F.col(k).alias("__k") for k in keys), "__before")
    same = F.col("__range") == F.col("__r")
    if keys:
        same = same & F.col(by).eqNullSafe(F.col("__k"))
    place = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order)) - 1
    out = ranged.withColumn("__place", place).join(F.broadcast(held), same, "left")
    return out.withColumn(name, F.col("__place") + F.coalesce("__before", F.lit(0))).drop("__range", "__place", "__before", "__r", "__k")


def looked_up(facts: DataFrame, key: str, dims: DataFrame) -> DataFrame:
    """Left join of ``facts``, a written table, to one row a ``key``. The facts of hot keys, whose number is bounded, meet their rows by broadcast, so that no task gets a hot key's facts; mostly there are none."""
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[key] for r in counts.where(F.col("n") > max(HOT_LEAST, facts.count() // HOT_SHARE)).select(key).limit(HOT_SHARE).collect()]
    if not hot:
        return facts.join(dims, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    met = facts.where(is_hot).join(F.broadcast(dims.where(is_hot)), key, "left")
    return met.unionByName(facts.where(~is_hot).join(dims.where(~is_hot), key, "left"))
