"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's ids into chunks where the content says so.
Chunks are named by the hash of their ids and stored once; a document is a recipe, the list of its
chunks' names, named by the hash of that list. The index holds the documents in ascending doc_id
order with each one's first position in the whole stream. A Merkle manifest fixes content and order:
leaves are index rows (doc_id, recipe name, n, copies, start), then come blocks of ``LEAVES`` rows,
groups of ``LEAVES`` blocks, files and one root, which also holds the numbers of rows and ids.

Layout below one folder: ``objects/kind=chunk`` (name, ids as little-endian unsigned 16- or 32-bit
integers), ``objects/kind=recipe`` (name, doc_id, chunk names), ``index`` and ``manifest``.
Reading computes the manifest again from the index and compares both ways, hashes every chunk and
recipe again, and raises on any difference and on any missing chunk or recipe.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.llm.bpe import WordEncoder, default_tokenizer
from stratum.llm.common import blocks, hot_keys, join_to_one
from stratum.runtime import fresh_path, map_arrow, settle
from stratum.sources.tables import table

END_ID = 2
NAME_BYTES = 16
LEAST, MEAN_BITS, MOST, WINDOW = 64, 8, 1024, 8
LEAVES = 4096
_OBJECTS = "kind string, name binary, doc_id long, n long, copies long, payload binary"
_RECIPES = "name binary, doc_id long, n long, copies long, payload binary, kind string"


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NAME_BYTES).digest()


def marks(ids: np.ndarray) -> np.ndarray:
    """Positions after which the content says to cut. No chunk ends within ``LEAST`` ids of a document's start, so a window never counts that reaches into the document before: many documents' ids may follow each other."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(len(ids), np.uint64)
    for j in range(min(WINDOW, len(ids))):
        rolled[j:] += mixed[: len(ids) - j] * np.uint64(0xD1342543DE82EF95 * (2 * j + 1) % (1 << 64))
    return np.flatnonzero((rolled >> np.uint64(64 - MEAN_BITS)) == 0) + 1


def cuts(size: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of ``size`` ids: at marks, with ``LEAST`` to ``MOST`` ids a chunk but for the last."""
    out, last = [], 0
    for mark in [*marked, size]:
        while mark - last > MOST:
            last += MOST
            out.append(last)
        if mark > last and (mark - last >= LEAST or mark == size):
            out.append(mark)
            last = mark
    return out


def _objects(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """Recipe and chunk rows of every document; a chunk is left out where the same block of texts had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(tokenizer)
        width = "<u2" if len(encoder.token_sizes()) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        seen: set[bytes] = set()
        for part, texts in blocks(batches, "text"):
            if len(seen) > 200_000:
                seen.clear()
            ids, counts = encoder.encode(texts)
            stream = np.insert(ids, np.cumsum(counts), end_id)
            marked, narrow = marks(stream), stream.astype(width).tobytes()
            item, ends = int(width[-1]), np.cumsum(counts + 1)
            among = np.searchsorted(marked, [0, *ends], "right").tolist()
            names, sizes, payloads = [], [], []
            recipes: dict[tuple[int | None, bytes], list] = {}
            start = 0
            for k, (doc_id, stop) in enumerate(zip(part.column(0).to_pylist(), ends.tolist(), strict=True)):
                parts, last = [], start
                for cut in cuts(stop - start, (marked[among[k] : among[k + 1]] - start).tolist()):
                    payload = narrow[item * last : item * (start + cut)]
                    name = name_of(payload)
                    parts.append(name)
                    if name not in seen:
                        seen.add(name)
                        names.append(name)
                        sizes.append(start + cut - last)
                        payloads.append(payload)
                    last = start + cut
                recipe = b"".join(parts)
                held = recipes.setdefault((doc_id, name_of(recipe)), [stop - start, 0, recipe])
                held[1] += 1
                start = stop
            n, many = len(names), len(recipes)
            columns = [
                pa.array(["chunk"] * n + ["recipe"] * many),
                pa.array(names + [name for _, name in recipes], pa.binary()),
                pa.array([None] * n + [doc_id for doc_id, _ in recipes], pa.int64()),
                pa.array(sizes + [x[0] for x in recipes.values()], pa.int64()),
                pa.array([1] * n + [x[1] for x in recipes.values()], pa.int64()),
                pa.array(payloads + [x[2] for x in recipes.values()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "name", "doc_id", "n", "copies", "payload"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_arrow(chosen, run, _OBJECTS)


def _hashed(rows: DataFrame, keys: list[str], order: str, leaf: F.Column) -> DataFrame:
    """One hash for each group, of its leaves in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), leaf.alias("leaf")))), lambda x: x["leaf"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(listed, ","), 256).alias("hash"))


def _manifest(index: DataFrame) -> DataFrame:
    """(level, file, part, hash) of groups of blocks, files and the root. There is always a root, also of no rows."""
    leaf = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("name"), "n", "copies", "start")
    blocks_ = _hashed(index, ["file", "block"], "row", leaf).withColumn("part", F.floor(F.col("block") / LEAVES))
    groups = _hashed(blocks_, ["file", "part"], "block", F.col("hash"))
    files = _hashed(groups, ["file"], "part", F.col("hash"))
    totals = index.agg(F.concat_ws("|", F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("copies")), F.lit(0))).alias("totals"))
    root = _hashed(files, [], "file", F.col("hash")).crossJoin(totals).select(F.sha2(F.concat_ws("|", "hash", "totals"), 256).alias("hash"))
    row = lambda level, df, file, part: df.select(F.lit(level).alias("level"), file.cast("int").alias("file"), part.cast("long").alias("part"), "hash")
    none = F.lit(None)
    return row("group", groups, F.col("file"), F.col("part")).unionByName(row("file", files, F.col("file"), none)).unionByName(row("root", root, none, none))


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every document (null text: empty), append ``end_id`` and write the store.

    Repeated rows count as copies of one index row. Null ids come first. No rows give a store of no documents.
    """
    spark = docs.sparkSession
    rows = _objects(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id)
    # Workers have combined what they saw, so rows go straight to where they are sorted, once. Copies of a text have one recipe name: ids keep these apart.
    dealt = rows.repartition("name", "doc_id")
    unique = dealt.groupBy("kind", "name", "doc_id").agg(F.first("n").alias("n"), F.first("payload").alias("payload"), F.sum("copies").alias("copies"))
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/objects").where("kind = 'recipe'")
    ordered = recipes.select("doc_id", "name", "n", "copies").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("name")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "name")
    filed = settle(ordered.withColumn("file", F.spark_partition_id()), "filed")
    before = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "name")
    totals = filed.groupBy("file").agg(F.sum(F.col("n") * F.col("copies")).alias("total"))
    offsets = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("offset"))
    run_up = F.sum(F.col("n") * F.col("copies")).over(before) - F.col("n") * F.col("copies")
    index = filed.withColumn("row", F.row_number().over(before)).withColumn("within", run_up).join(F.broadcast(offsets), "file")
    index = index.select("file", "row", F.floor((F.col("row") - 1) / LEAVES).alias("block"), "doc_id", "name", "n", "copies", (F.col("offset") + F.col("within")).alias("start"))
    index.write.option("compression", "zstd").parquet(f"{path}/index")
    _manifest(_index(spark, path)).coalesce(1).write.parquet(f"{path}/manifest")


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file int, row int, block long, doc_id long, name binary, n long, copies long, start long").parquet(f"{path}/index")


def _crc_tables() -> np.ndarray:
    """For 2**k appended zero bytes: what they make of each byte of a CRC-32, as tables [k, place, value]."""
    place = np.arange(256, dtype=np.uint32)
    base = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    one = np.zeros((4, 256), np.uint32)
    for p in range(4):
        value = place << np.uint32(8 * p)
        one[p] = (value >> np.uint32(8)) ^ base[value & 255]
    out = [one]
    for _ in range(40):
        out.append(_apply(out[-1], _apply(out[-1], np.stack([place << np.uint32(8 * p) for p in range(4)]))))
    return np.stack(out)


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> np.uint32(8)) & 255] ^ tables[2][(crc >> np.uint32(16)) & 255] ^ tables[3][crc >> np.uint32(24)]


def crc32_joined(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of two parts put together, from the CRC-32 of each and the second's length."""
    out = first.copy()
    for k in range(int(second_bytes.max(initial=0)).bit_length()):
        odd = np.flatnonzero(second_bytes >> k & 1)
        out[odd] = _apply(tables[k], out[odd])
    return out ^ second


def _read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(name, crc, n) of every stored chunk, from its bytes, which must have that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for name, n, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name_of(payload) != name:
                    raise ValueError(f"chunk {name.hex()} has other bytes")
                ids = np.frombuffer(payload, "<u4" if len(payload) == 4 * n else "<u2")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), batch.column(1)], ["name", "crc", "n"])

    chunks = spark.read.schema("name binary, n long, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'")
    return map_arrow(chunks.select("name", "n", "payload"), run, "name binary, crc long, n long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, name) of every document, from the store's files alone.

    Raises where a chunk's or recipe's bytes have another name than theirs, a chunk is missing, or the
    manifest differs. Equal rows each get their own positions.
    """
    fresh, stored = (x.select(F.struct("level", "file", "part", "hash").alias("x")) for x in (_manifest(_index(spark, path)), spark.read.schema("level string, file int, part long, hash string").parquet(f"{path}/manifest")))
    wrong = fresh.select("x", F.lit(1).alias("n")).unionByName(stored.select("x", F.lit(-1).alias("n"))).groupBy("x").agg(F.sum("n").alias("n")).where("n <> 0")
    if not wrong.isEmpty() or stored.where("x.level = 'root'").isEmpty():
        raise ValueError("the index differs from its manifest")
    recipes = spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'recipe'").groupBy("name").agg(F.first("payload").alias("payload"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, seq, chunk = [], [], []
            for name, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name_of(payload) != name:
                    raise ValueError(f"recipe {name.hex()} has other bytes")
                pieces = [payload[i : i + NAME_BYTES] for i in range(0, len(payload), NAME_BYTES)]
                recipe += [name] * len(pieces)
                seq += range(len(pieces))
                chunk += pieces
            yield pa.RecordBatch.from_arrays([pa.array(recipe, pa.binary()), pa.array(seq, pa.int64()), pa.array(chunk, pa.binary())], ["recipe", "seq", "name"])

    listed = settle(map_arrow(recipes, parts, "recipe binary, seq long, name binary"), "listed")
    uses = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    joined = join_to_one(listed, _read_chunks(spark, path), hot_keys(uses, "name"), "name")
    each = joined.groupBy("recipe").agg(F.array_sort(F.collect_list(F.struct("seq", "crc", "n"))).alias("parts"), F.count(F.lit(1)).alias("many"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _crc_tables()
        for batch in batches:
            flat = pa.RecordBatch.from_struct_array(batch.column(1).flatten())
            counts = np.diff(batch.column(1).offsets.to_numpy())
            if flat.column(1).null_count:
                raise ValueError("a recipe names a chunk that is not stored")
            crc, n = flat.column(1).to_numpy().astype(np.uint32), flat.column(2).to_numpy()
            first = np.cumsum(counts) - counts
            out = crc[first].copy()
            for step in range(1, int(counts.max(initial=0))):
                on = np.flatnonzero(counts > step)
                out[on] = crc32_joined(out[on], crc[first[on] + step], 4 * n[first[on] + step], tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.astype(np.int64)), pa.array(np.add.reduceat(n, first) if len(n) else n)], ["name", "ids_crc32", "n_tokens"])

    whole = settle(map_arrow(each.select("recipe", "parts"), combine, "name binary, ids_crc32 long, n_tokens long"), "read")
    index = _index(spark, path).select("doc_id", "name", "start", "copies", "n")
    counts = index.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = join_to_one(index, whole, hot_keys(counts, "name"), "name")
    n_tokens = F.when(F.col("n_tokens").eqNullSafe(F.col("n")), F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("no recipe of the index's length under "), F.hex("name"))))
    return found.select("doc_id", "name", "start", n_tokens.alias("n_tokens"), "ids_crc32", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")).select(
        "doc_id", (F.col("start") + F.col("copy") * F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", F.lower(F.hex("name")).alias("name")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) put together again from chunks, a row for each copy: for exports of documents that fit a row. A missing chunk raises."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/objects").where("kind = 'recipe'")
    seqs = F.expr(f"sequence(0, cast(length(payload) / {NAME_BYTES} as int) - 1)")
    listed = recipes.select("doc_id", "copies", F.col("name").alias("recipe"), F.posexplode(F.transform(seqs, lambda i: F.substring(F.col("payload"), i * NAME_BYTES + 1, F.lit(NAME_BYTES)))).alias("seq", "name"))
    chunks = spark.read.schema("name binary, payload binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").select("name", F.hex("payload").alias("payload"))
    uses = listed.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    joined = join_to_one(listed, chunks, hot_keys(uses, "name"), "name")
    known = F.coalesce("payload", F.raise_error(F.lit("a recipe names a chunk that is not stored")))
    each = joined.groupBy("doc_id", "recipe", "copies").agg(F.array_sort(F.collect_list(F.struct("seq", known.alias("payload")))).alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda x: x["payload"]), ""))
    return each.select("doc_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids")


def op9_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    write_store(table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
