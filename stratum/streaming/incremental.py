"""Work on arriving rows, micro-batch by micro-batch, that a batch interrupted anywhere repeats without doubles.

A batch writes its results below its own number, in place of what an interrupted run of it left, and last a row that says it
is done. Readers see batches that are done only. Spark's checkpoint gives a repeated batch the rows that it had before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A folder of batches; None while there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    held = _read(spark, path)
    return None if held is None else held.where(F.col("batch") < batch)


def prepare_new(arriving: DataFrame, target: str, prepare: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataStreamWriter:
    """A stream of revisions (key, ...), each prepared once, when it first comes; start the writer with a checkpointLocation.

    ``prepare`` gets a batch's new revisions, one row a key (of several, the one with the smallest row hash); what it returns is
    written below ``target``/prepared, the keys below ``target``/done. Rows without a key are left out, as nothing could tell that
    they were done.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        smallest = F.min_by(F.struct(*batch.columns), F.xxhash64(*batch.columns))
        new = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(smallest.alias("r")).select("r.*")
        done = _before(spark, f"{target}/done", number)
        if done is not None:
            new = new.join(done.select(key), key, "left_anti")
        prepare(new).write.mode("overwrite").parquet(f"{target}/prepared/batch={number}")
        # Read from the batch itself again: what was prepared is decided by the done keys of earlier batches only.
        new.select(key).write.mode("overwrite").parquet(f"{target}/done/batch={number}")

    return arriving.writeStream.foreachBatch(run)


def prepared(spark: SparkSession, target: str) -> DataFrame | None:
    """Rows of all batches that are done, with the batch of each; None before the first."""
    rows, done = _read(spark, f"{target}/prepared"), _read(spark, f"{target}/done")
    return None if rows is None or done is None else rows.join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi")


def split_late(arriving: DataFrame, target: str, time: str, delay: str) -> DataStreamWriter:
    """A stream of rows, each kept in full as on time or late; start the writer with a checkpointLocation.

    The watermark of a batch is the greatest ``time`` of all batches before it, less ``delay``; rows below it are late. A null time
    is late once there is a watermark. On-time rows go to ``target``/rows/late=false, late ones to the side table late=true.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = _before(spark, f"{target}/marks", number)
        seen = marks.agg(F.max("mark")).first()[0] if marks is not None else None
        late = F.lit(False) if seen is None else F.coalesce(F.col(time) < F.lit(seen) - F.expr(f"interval {delay}"), F.lit(True))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{target}/rows/batch={number}")
        batch.agg(F.max(time).alias("mark")).where("mark IS NOT NULL").write.mode("overwrite").parquet(f"{target}/marks/batch={number}")

    return arriving.writeStream.foreachBatch(run)


def late_and_timely(spark: SparkSession, target: str) -> DataFrame | None:
    """All rows so far with ``late`` and ``batch``; None before the first batch."""
    rows = _read(spark, f"{target}/rows")
    # A partition's folder gives its value as text.
    return None if rows is None else rows.withColumn("late", F.col("late").cast("string") == "true")
