"""Streams that stop amid a batch, against one batch over everything."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratum.operators import chunking, documents
from stratum.streaming import incremental

FILES = [[(1, "# a\n\nb c"), (2, "- x\n- y")], [(2, "- x\n- y"), (3, "z")], [(3, "z"), (4, "| a |\n|---|\n| b |"), (None, "lost")], [(1, "# a\n\nb c")], [(5, "new"), (5, "new")]]


def arrive(spark, folder, rows, schema, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in{n}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def chunks(docs):
    return chunking.chunk_tree(documents.block_tree(docs))


@pytest.mark.parametrize("stop_at", [None, 2])
def test_a_stopped_stream_equals_a_batch(spark, tmp_path, stop_at):
    schema = "doc_id long, text string"
    target, source = str(tmp_path / "out"), str(tmp_path / "in")
    calls = []

    def failing(docs):
        if len(calls) == stop_at:
            calls.append("stopped")
            # As if the driver died between writing the chunks and noting that they are done.
            chunks(docs).write.mode("overwrite").parquet(f"{target}/prepared/batch={stop_at}")
            raise RuntimeError("stopped")
        calls.append(None)
        return chunks(docs)

    def run():
        q = incremental.prepare_new(stream(spark, source, schema), target, failing).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    for n, rows in enumerate(FILES):
        arrive(spark, source, rows, schema, n)
    if stop_at is not None:
        with pytest.raises(Exception, match="stopped"):
            run()
        held = incremental.prepared(spark, target)
        assert held is None or not held.where(F.col("batch") >= stop_at).count()
    run()
    want = chunks(spark.createDataFrame(sorted({r for f in FILES for r in f if r[0] is not None}), schema))
    got = incremental.prepared(spark, target)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    before = len(calls)
    arrive(spark, source, [(1, "# a\n\nb c"), (6, "six")], schema, 99)
    run()
    assert len(calls) == before + 1
    assert [r.document_id for r in incremental.prepared(spark, target).where(F.col("batch") == len(FILES)).collect()] == [6]


def test_late_rows_are_kept_aside(spark, tmp_path):
    schema, base = "id long, ts timestamp", datetime(2024, 1, 1)
    at = lambda m: base + timedelta(minutes=m)
    parts = [[(1, at(0)), (2, at(30))], [(3, at(25)), (4, at(19)), (5, at(60))], [(6, at(49)), (7, at(50)), (8, None)], [(9, at(70))]]
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for n, rows in enumerate(parts):
        arrive(spark, source, rows, schema, n)
        q = incremental.split_late(stream(spark, source, schema), target, "ts", "10 minutes").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = incremental.late_and_timely(spark, target)
    assert {(r.id, r.late) for r in rows.collect()} == {(1, False), (2, False), (3, False), (4, True), (5, False), (6, True), (7, False), (8, True), (9, False)}
    hourly = lambda df: {(r.h, r.n) for r in df.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert hourly(rows) == hourly(spark.createDataFrame([r for p in parts for r in p], schema))
