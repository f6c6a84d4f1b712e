"""Session defaults and durable intermediate results.

Lineage is cut only through files in the folder that the cluster names in
``spark.checkpoint.dir``; a folder of our own is set only where that is unset (tests, laptops).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of a written table for each task and file, where their number is known.
FILE_ROWS = 1 << 13

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("stratum")
    for key, value in {**SESSION_DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and all work is on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="stratum-checkpoints-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/stratum-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step", most: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it from there.

    This cuts lineage, survives lost executors and, other than a checkpointed RDD, keeps column
    pruning and carries no constraints of earlier plans into later ones.

    most: no more rows than these are to come. Where they need fewer tasks of FILE_ROWS than a shuffle has partitions, so many
    tasks and files are made: for each file executors on a local disk start programs that set its rights, at the cost of milliseconds.
    """
    if most is not None and (tasks := max(1, -(-most // FILE_ROWS))) < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(tasks)
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def discard(*settled: DataFrame | None) -> None:
    """Delete tables of ``settle`` that nothing will read again. What ``settle`` didn't return is left alone."""
    for df in settled:
        path = getattr(df, "settled_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer partitions than cores is dealt out before work that costs far more than a shuffle of it; larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that functions of it can run there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="stratum-code-")) / "stratum_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
