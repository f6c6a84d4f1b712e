"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, by hash in ``WORDS`` buckets, its trigrams of character classes
(``CLASSES`` of them), which do not depend on a language's words, the repetition of its words and its
size. Document frequencies come from all documents. The labelled rows to learn from, at most ``MOST_LABELLED`` of each label, chosen by a
hash of doc_id, give a truncated SVD of the weighted term matrix; their vectors, a bounded number, are
broadcast. Every document is compared with every one of them by exact cosine, block by block, and the
``NEIGHBOURS`` most similar vote, weighted by similarity and by the share that their label has among
all labelled rows against the share in the sample.

Vectors are rounded to integers before each product, so that products are exact in double precision and
a text's score depends neither on what it shares a block with nor on the order of sums. Of equally
similar neighbours the earlier one in order of doc_id votes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.llm.winnow import Words
from stratum.runtime import map_arrow
from stratum.sources.tables import table

FOLDS = 5
MOST_LABELLED = 2000
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 8
THRESHOLD = 0.3
CLASSES = 16
_TRIGRAMS = CLASSES**3
_EXTRA = 64
WORDS = 2048
WORD_WEIGHT = 0.3
TERMS = _TRIGRAMS + _EXTRA + WORDS
#: Bytes and rows of a block; its terms are a dense matrix.
_BLOCK, _ROWS = 512 << 10, 256
_GRID, _FINE = 1 << 14, 1 << 20


def _class_table() -> np.ndarray:
    """Classes of bytes: non-ASCII, lower, upper, digit, space, break, and single marks."""
    out = np.zeros(256, np.int16)
    out[:128] = 15
    for k, marks in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r", b".", b",;:", b"!?", b"|", b"$", b"%", b"&", b"*", b"#"), start=1):
        for b in marks:
            out[b] = k
    return out


_CLASS = _class_table()


def terms_of(texts: list[bytes]) -> np.ndarray:
    """Term weights of each text: square roots of the shares of its trigrams, one-hot buckets of repetition, variety and size, and square roots of the shares of its words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    code = _CLASS[raw].astype(np.int64)
    out = np.zeros((len(texts), TERMS), np.float32)
    if len(code) > 2:
        tri = (code[:-2] * CLASSES + code[1:-1]) * CLASSES + code[2:]
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * _TRIGRAMS + tri[whole], minlength=len(texts) * _TRIGRAMS).reshape(len(texts), _TRIGRAMS)
        out[:, :_TRIGRAMS] = np.sqrt(counts / np.maximum(sizes, 1)[:, None])
    for i, text in enumerate(texts):
        words = text.split()
        n = len(words)
        again = sum(map(bytes.__eq__, words, words[1:])) / max(n - 1, 1)
        lines = text.split(b"\n")
        for base, value in ((0, again), (16, len(set(words)) / max(n, 1)), (32, len(set(lines)) / len(lines))):
            out[i, _TRIGRAMS + base + min(15, int(value * 16))] = 0.3
        out[i, _TRIGRAMS + 48 + min(15, n.bit_length())] = 0.3
    words = Words(texts)
    # Words are numbered from 1 on in the order of ``known``.
    bucket = np.fromiter((xxhash.xxh64_intdigest(w) % WORDS for w in words.known), np.int64, len(words.known))[words.codes - 1]
    counts = np.bincount(words.text_of * WORDS + bucket, minlength=len(texts) * WORDS).reshape(len(texts), WORDS)
    out[:, _TRIGRAMS + _EXTRA :] = WORD_WEIGHT * np.sqrt(counts / np.maximum(words.counts, 1)[:, None])
    return out


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that nothing is learnt from; a null id counts as the text ''."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % FOLDS == 0


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each term, over all of them: each task sends one row of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(TERMS, np.int64), 0
        for _, texts in blocks(batches, "text", _BLOCK, _ROWS):
            sums += (terms_of(texts) > 0).sum(axis=0)
            n += len(texts)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["n", "sums"])

    parts = map_arrow(docs, run, "n long, sums array<long>")
    # Sums are put together on the executors, so that the driver gets one row a term.
    each = parts.select("n", F.posexplode("sums").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS)
    for r in each:
        out[r.term] = r.df
    return out, max((r.n for r in each), default=0)


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term weights and label of at most ``most`` documents of each label, and each label's share among all that may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in blocks(batches, "text", _BLOCK, _ROWS):
            found = terms_of(raw)
            at = [np.flatnonzero(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([x.astype("<u2").tobytes() for x in at], pa.binary()), pa.array([found[i][x].astype("<f4").tobytes() for i, x in enumerate(at)], pa.binary())],
                ["doc_id", "y", "at", "w"],
            )

    rows = map_arrow(texts, run, "doc_id long, y int, at binary, w binary").groupBy("at", "w", "y").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id", "y", "at", "w").limit(4 * most).collect()
    x, y = np.zeros((len(rows), TERMS), np.float32), np.zeros(len(rows), np.int64)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r.w, "<f4")
        y[i] = r.y
    total = max(sum(shares.values()), 1)
    return x, y, np.array([shares.get(0, 0) / total, shares.get(1, 0) / total])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, dimensions: int = DIMENSIONS) -> dict:
    """The model: term weights, projection, labelled vectors and their votes. All of bounded size."""
    df, n = _frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    x, y, share = _labelled(docs, labels, most)
    if not len(y):
        return {"idf": idf, "prior": 0.5, "vectors": None}
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weighted = x
    k = min(dimensions, *weighted.shape)
    rng = np.random.default_rng(7)
    basis = weighted @ rng.standard_normal((TERMS, k + 16), dtype=np.float32)
    for _ in range(4):
        basis = weighted @ (weighted.T @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    projection = np.linalg.svd(q.T @ weighted, full_matrices=False)[2][:k].T.astype(np.float32)
    sample = np.array([(y == 0).mean(), (y == 1).mean()])
    vote = np.where(sample > 0, share / np.maximum(sample, 1e-9), 0).astype(np.float32)
    projection = np.rint(projection.astype(np.float64) * _GRID)
    return {"idf": idf, "projection": projection, "vectors": np.concatenate([_placed(x[i : i + _ROWS], projection) for i in range(0, len(x), _ROWS)]), "y": y, "vote": vote[y].astype(np.float64), "prior": float(share[1])}


def _placed(weighted: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Latent vectors of unit length, on a grid of 1 / _FINE: whole numbers. The product's terms are whole numbers and its sums below 2**53, so it is exact."""
    return np.rint(_unit(np.rint(_unit(weighted).astype(np.float64) * _GRID) @ projection) * _FINE)


def score_block(model: dict, texts: list[bytes], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of the weighted votes for label 1."""
    if model["vectors"] is None:
        return np.full(len(texts), model["prior"])
    similar = (_placed(terms_of(texts) * model["idf"], model["projection"]) @ model["vectors"].T).astype(np.int64)
    n = similar.shape[1]
    # Similarity first, then the earlier vector: no two are equal.
    ranked = similar * n + np.arange(n - 1, -1, -1)
    k = min(neighbours, n)
    best = np.sort(np.partition(ranked, n - k, axis=1)[:, n - k :], axis=1)
    at = n - 1 - best % n
    weight = np.maximum(best // n / _FINE**2, 1e-6) ** SHARPNESS * model["vote"][at]
    return np.clip((weight * (model["y"][at] == 1)).sum(axis=1) / weight.sum(axis=1), 0, 1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, or with ``keep`` the rows' own columns and ``__predicted``.

    Null and empty texts are scored like any other, by their size and variety terms. Repeated rows get
    equal scores. Labels of unknown, null or repeated documents: unknown and null ones are left out,
    of repeated ones the lower label holds. Without labels every score is 0.5. Labels, languages,
    sources and ids are never part of a text's vector.
    """
    chosen = _chosen(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(chosen, labels))
    fields = [f for f in docs.schema.fields] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, text_col if keep else "text", _BLOCK, _ROWS):
            found = score_block(model.value, texts)
            if keep:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array((found >= threshold).astype(np.int32))], [*part.schema.names, "__predicted"])
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if keep:
        return map_arrow(docs, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "`__predicted` int"]))
    scored = map_arrow(chosen, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""
    return score(docs, labels, id_col, text_col, keep=True).where("__predicted = 1").drop("__predicted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
