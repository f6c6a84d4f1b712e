"""SimHash near-duplicates through a segment-popcount embedding and a grid range join.

A fingerprint of 64 bits is embedded as 32 bit counts, one for each segment of two bits. The
Manhattan distance of two embeddings is a lower bound of the Hamming distance, so of two
fingerprints within ``MOST_BITS`` = 4 bits one half (16 counts) is within Manhattan distance 2.
The grid has the halves' counts as cells. Every fingerprint goes to the cells within one step of
its own, so any two halves within two steps meet in a cell; what meets is verified exactly.

No pairs within a group of copies are made: equal fingerprints are one node; in each cell the
members near its smallest fingerprint are linked to that one, components are taken, and only
members of different components in a cell are compared further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratum.llm.common import blocks, looked_up
from stratum.llm.components import components
from stratum.runtime import discard, map_arrow, settle
from stratum.sources.tables import table

MOST_BITS = 4
SHINGLE_WORDS = 4
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EVEN_BITS = 0x55555555


def fingerprint_block(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED, most: int = 1 << 15) -> np.ndarray:
    """The SimHash of each text as uint64; no words give zero. Bits of about ``most`` shingles are held at once, however long a text is."""
    digest = xxhash.xxh64_intdigest
    counts, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    hashes: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def add_up() -> None:
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)
        sums[owners] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        for held in (hashes, owners, starts):
            held.clear()

    for i, text in enumerate(texts):
        found = text.translate(_LOWER).split()
        if not found:
            continue
        line = b" ".join(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
        ends = np.cumsum(sizes)
        n = max(1, len(found) - words + 1)
        begins, ends = (ends - sizes)[:n], ends[-n:] - 1
        counts[i] = n
        for at in range(0, n, most):
            owners.append(i)
            starts.append(len(hashes))
            hashes.extend([digest(line[s:e], seed) for s, e in zip(begins[at : at + most].tolist(), ends[at : at + most].tolist(), strict=True)])
            if len(hashes) >= most:
                add_up()
    if hashes:
        add_up()
    return np.packbits(sums * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_block(texts).view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, "doc_id long, fp long")


def _with_cells(nodes: DataFrame) -> DataFrame:
    """A row for each grid cell of each fingerprint: both halves' counts, and all counts one step away."""
    bits = nodes.withColumns({f"bits{k}": F.expr(f"shiftrightunsigned(fp, {32 * k}) & 4294967295L") for k in (0, 1)})
    halves = bits.withColumns({f"half{k}": F.expr(f"(bits{k} & {_EVEN_BITS}L) + (shiftrightunsigned(bits{k}, 1) & {_EVEN_BITS}L)") for k in (0, 1)})
    cells = [
        f"""transform(concat(array(half{k}),
            transform(filter(sequence(0, 30, 2), i -> (half{k} & shiftleft(3L, i)) < shiftleft(2L, i)), i -> half{k} + shiftleft(1L, i)),
            transform(filter(sequence(0, 30, 2), i -> (half{k} & shiftleft(3L, i)) > 0), i -> half{k} - shiftleft(1L, i))), x -> x + {k << 40}L)"""
        for k in (0, 1)
    ]
    return halves.select(*nodes.columns, F.explode(F.expr(f"concat({', '.join(cells)})")).alias("cell"))


def links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(a, b) of distinct fingerprints within ``most`` (4 at most) differing bits: not all such pairs, but enough that the components are theirs."""
    if most > MOST_BITS:
        raise ValueError(f"the grid's steps cover {MOST_BITS} bits")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= most
    cell = Window.partitionBy("cell")
    stars = (
        _with_cells(nodes.select("fp"))
        .withColumn("head", F.min("fp").over(cell))
        .where((F.col("fp") != F.col("head")) & near(F.col("fp"), F.col("head")))
        .select(F.col("fp").alias("a"), F.col("head").alias("b"))
        .distinct()
    )
    stars = settle(stars)
    own = components(stars).select(F.col("node").alias("fp"), F.col("component").alias("own"))
    labelled = settle(nodes.join(own, "fp", "left").select("fp", F.coalesce("own", "fp").alias("own")), most=nodes.count())
    mixed = (
        _with_cells(labelled)
        .withColumn("lowest", F.min("own").over(cell))
        .withColumn("highest", F.max("own").over(cell))
        .where("lowest <> highest")
        .select("cell", "fp", "own")
    )
    x, y = mixed.alias("x"), mixed.alias("y")
    across = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.own") < F.col("y.own")) & near(F.col("x.fp"), F.col("y.fp")))
    return stars.unionByName(across.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    fingerprint: 16 lowercase hex digits; component_id: the smallest doc_id among all documents whose
    fingerprints can be reached over links of at most ``most`` differing bits.
    Null or empty texts have fingerprint zero and link like any other. A null id is never a component's
    id unless all ids of the component are null. Rows with the same id each get a row. No rows, no rows.
    """
    return _grouped(docs, id_col, text_col, most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; root tells components apart whose smallest ids are the same."""
    rows = settle(fingerprints(docs, id_col, text_col))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), most=rows.count())
    n_nodes = nodes.count()
    found = components(links(nodes.select("fp"), most)).withColumnsRenamed({"node": "fp", "component": "root"})
    joined = settle(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), most=n_nodes)
    least = settle(joined.groupBy("root").agg(F.min("least").alias("component_id")), most=n_nodes)
    dims = settle(looked_up(joined.select("fp", "root"), "root", least, "root").select("fp", "root", "component_id"), most=n_nodes)
    discard(joined, least)
    return looked_up(rows, "fp", dims, "fp").select("doc_id", "fp", "root", "component_id")


def _with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns of ``docs`` and ``__fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fingerprint_block(texts).view(np.int64))], [*part.schema.names[:-1], "__fp"])

    return map_arrow(docs.withColumn("__text", F.col(text_col).cast("string")), run, StructType([*docs.schema.fields, StructField("__fp", LongType())]))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns: one of each group.

    Rows without an id are kept, as no smaller id can be told. Where rows share an id, a row goes by id and
    fingerprint: each component keeps one row with its smallest id, of several fingerprints the smallest.
    """
    found = settle(_grouped(docs, id_col, text_col))
    heads = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("head")).where("head")
    kept = docs.join(heads.select(F.col("doc_id").alias("__head")), F.col(id_col) == F.col("__head"), "left_semi")
    clashing = heads.where("n > 1").select("doc_id")
    if not clashing.isEmpty():
        # Fingerprints are taken again of the rows with such ids only.
        ids = clashing.select(F.col("doc_id").alias("__head"))
        chosen = found.where("doc_id = component_id").join(clashing, "doc_id", "left_semi").groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("b")).select(F.col("b.doc_id").alias("__head"), F.col("b.fp").alias("__chosen"))
        shared = _with_fingerprint(docs.join(ids, F.col(id_col) == F.col("__head"), "left_semi"), text_col)
        shared = shared.join(chosen, (F.col(id_col) == F.col("__head")) & (F.col("__fp") == F.col("__chosen")), "left_semi").dropDuplicates([id_col, "__fp"]).drop("__fp")
        kept = kept.join(ids, F.col(id_col) == F.col("__head"), "left_anti").unionByName(shared)
    if docs.schema[id_col].nullable:
        kept = kept.unionByName(docs.where(F.col(id_col).isNull()))
    return kept


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
