"""An inverted-list index of vectors: cells by k-means on a bounded sample, every vector in its nearest cell.

The table is written once, in ranges of (cell, id), so a cell of very many vectors is in several files and no task has it
whole. A search sends the queries, with the cells that each probes, to the ranges of the table; a range multiplies its rows of
a cell with that cell's queries only. Probing all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratum.operators.retrieval import TILE_VALUES, dense_topk
from stratum.runtime import map_arrow, settle

#: Vectors that the cells are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 16_384
MOST_CELLS = 4096
ROUNDS = 10
#: Queries that are sent at once, at most; more are asked in blocks.
MOST_QUERIES = 50_000


@dataclass
class VectorIndex:
    """``cells``: unit vectors, one a row; ``table`` (cell, id, vector): unit vectors of all rows that have a direction."""

    cells: np.ndarray
    table: DataFrame


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def _nearest(rows: np.ndarray, cells: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest cells of each row, nearest first, ties by number; tiles bound the products held."""
    out = np.empty((len(rows), n), np.int32)
    step = max(1, TILE_VALUES // max(1, len(cells)))
    for a in range(0, len(rows), step):
        out[a : a + step] = np.argsort(-np.round(rows[a : a + step] @ cells.T, 9), axis=1, kind="stable")[:, :n]
    return out


def fit_cells(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means of unit vectors by cosine; cells that lose all rows take the rows farthest from theirs."""
    rows = _unit(sample)
    cells = rows[np.linspace(0, len(rows) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        mine = _nearest(rows, cells)[:, 0]
        sums = np.zeros_like(cells)
        np.add.at(sums, mine, rows)
        empty = np.flatnonzero(np.bincount(mine, minlength=n) == 0)
        if len(empty):
            sums[empty] = rows[np.argsort(np.einsum("ij,ij->i", rows, cells[mine]), kind="stable")[: len(empty)]]
        cells = _unit(sums)
    return cells


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """The index of ``vectors`` (id, vector). cells: by default the root of the number of rows, at most ``MOST_CELLS``.

    Rows without a vector, with null or not finite values, of another dimension than most of the sample or all zero have no
    direction: no search can return them, and they are left out, as ``dense_topk`` leaves them out.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    typed = vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v")).where(finite)
    dimensions = typed.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dimensions:
        return VectorIndex(np.zeros((0, 0)), settle(vectors.select(F.lit(0).alias("cell"), "id", F.array().cast("array<double>").alias("vector")).limit(0), "vector-index"))
    size, total = dimensions[0]["d"], dimensions[0]["count"]
    held = typed.where(F.size("v") == size)
    chosen = held.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    n = max(1, min(cells or int(total**0.5), MOST_CELLS, len(chosen)))
    centres = fit_cells(np.array([r.v for r in chosen]), n)
    shared = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * size, pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(_nearest(rows, shared.value)[:, 0]), batch.column(0), lists], ["cell", "id", "vector"])

    kind = vectors.schema["id"].dataType.simpleString()
    return VectorIndex(centres, settle(map_arrow(held, run, f"cell int, id {kind}, vector array<double>").repartitionByRange("cell", "id").sortWithinPartitions("cell", "id"), "vector-index"))


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the best of each query's ``probes`` nearest cells by exact cosine, ties by id; all cells are exact.

    queries (query_id, vector); those of another dimension than the index's or without a direction have no rows.
    """
    spark = index.table.sparkSession
    n, size = index.cells.shape
    typed = settle(queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("v")).where((F.size("v") == size) & F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))), "index-queries")
    kind, key_type = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    blocks = -(-2 * typed.count() // MOST_QUERIES) or 1
    found = None
    for b in range(blocks):
        rows = typed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if n else []
        matrix = _unit(np.array([r.v for r in rows], float).reshape(len(rows), size))
        near = _nearest(matrix, index.cells, min(probes, n)) if len(rows) else np.zeros((0, 1), np.int32)
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], matrix, near))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, matrix, near = shared.value
            for batch in batches:
                cell = batch.column(0).to_numpy()
                vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
                for a, z in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                    asked = np.flatnonzero((near == cell[a]).any(axis=1))
                    step = max(1, TILE_VALUES // (z - a))
                    for first in range(0, len(asked), step):
                        mine = asked[first : first + step]
                        score = np.round(vectors[a:z] @ matrix[mine].T, 6)
                        least = np.partition(score, max(z - a - k, 0), axis=0)[max(z - a - k, 0)]
                        row, col = np.nonzero(score >= least)
                        yield pa.RecordBatch.from_arrays([pa.array([keys[mine[c]] for c in col.tolist()], key_type), batch.column(1).take(pa.array(a + row)), pa.array(score[row, col])], ["query_id", "id", "score"])

        part = map_arrow(index.table, run, f"query_id {kind}, id {index.table.schema['id'].dataType.simpleString()}, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(queries, k, probes, cells, recall): which share of the exact ``k`` best the search finds."""
    exact = dense_topk(vectors, queries, k).select("query_id", "id")
    got = search(index, queries, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
    share = exact.join(got, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return share.select("queries", F.lit(k).alias("k"), F.lit(probes).alias("probes"), F.lit(len(index.cells)).alias("cells"), "recall")


def probes_for(index: VectorIndex, vectors: DataFrame, target: float = 0.95, k: int = 10, sample: int = 200) -> int:
    """The fewest probes, of 4 and its steps by half, with a recall of ``target`` for ``sample`` rows of ``vectors`` asked against all.

    Those with the smallest hashes of their ids are asked; vectors without structure need most cells, and all cells always do.
    """
    asked = settle(vectors.orderBy(F.xxhash64("id"), "id").limit(sample).withColumnRenamed("id", "query_id"), "index-sample")
    exact = settle(dense_topk(vectors, asked, k).select("query_id", "id"), "index-exact")
    n, probes = len(index.cells), 4
    while probes < n:
        got = search(index, asked, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
        if (exact.join(got, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1) >= target:
            return probes
        probes += max(1, probes // 2)
    return max(n, 1)
