"""Katz backoff language model: counts, Good-Turing discounts, normalised backoff weights and scores of whole texts.

P(w | h) is d(c) c(hw) / C(h) where hw was seen in training, else b(h) P(w | h without its first word); unseen h has weight
1. At the bottom P(w) is d(c) c(w) / N, and what discounting frees goes to one unknown word. d is Good-Turing's for counts
up to ``MOST_DISCOUNTED``, of each order by its own counts of counts; b(h) shares out exactly what h's words leave. A context
of which no count is discounted gets one more count, so that it leaves something. A text's first words have shorter contexts.

Texts become blocks of numbered words, written once. What a block asks of the corpus (the counts of its distinct words, of
its distinct n-grams, the weights of its contexts) it asks once, however often it holds it, in packed rows of one block and
bucket; a bucket, chosen by the hash of what is asked for, sees what all blocks hold of it, adds it up and answers. So no
word, pair or context is hot, and one task holds about ``BUCKET_TOKENS`` tokens' n-grams. n-grams are told apart by the
numbers of their context and word, words by their bytes; no hash stands for either. Buckets keep the model's tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import fresh_path, map_arrow, settle, ship, spread
from stratum.sources.tables import table

ORDER = 2
MOST_DISCOUNTED = 5
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 1 << 21
_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, tokens binary"
_ASKED = "bucket int, block long, context binary, word binary, n binary, more binary"
_TABLES = "kind string, bucket int, block long, a binary, b binary, c binary, stats array<long>"


def pack(x: np.ndarray, delta: bool = False) -> bytes:
    """An array of integers as bytes: differences if asked, the least width, equal bytes of all together, compressed."""
    x = np.asarray(x, np.int64)
    if delta:
        x = np.diff(x, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or (x.min() >= -(1 << (8 * w - 1)) and x.max() < 1 << (8 * w - 1)))
    planes = np.ascontiguousarray(x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width, delta]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width, delta = data[0], data[1]
    planes = np.frombuffer(zstandard.decompress(data[2:]), np.uint8).reshape(width, -1)
    x = np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64)
    return np.cumsum(x) if delta else x


def _pack_floats(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(np.asarray(x, "<f8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_floats(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).view("<f8").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    """Words hold no space; the end of a text is the empty word. One more space tells no words from that."""
    return zstandard.compress(b"".join(w + b" " for w in words), 1)


def _unpack_words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b" ")[:-1]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(0), d(1), ...: Good-Turing's factors from the numbers of things seen once, twice, and so on; larger counts keep all.

    Where they don't lie between 0 and 1, or a number is 0, the same is tried for fewer counts; for none, nothing is discounted.
    """
    n = [0, *counts_of_counts]
    for k in range(len(n) - 2, 0, -1):
        if all(n[1 : k + 2]):
            rest = (k + 1) * n[k + 1] / n[1]
            if rest < 1:
                d = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return np.array([0.0, *d])
    return np.zeros(1)


def _discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0) * counts


def _stats(counts: np.ndarray) -> list[int]:
    """All, distinct, and how many were seen once, twice, ..."""
    seen = counts[counts > 0]
    return [int(seen.sum()), len(seen), *np.bincount(np.minimum(seen, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2].tolist()]


# Blocks


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents (doc_id, held, text) as numbers of the block's own words; 0 is the end of a text."""
    seq = TaskContext.get().partitionId() << 32
    for part, texts in blocks(batches, "text", BLOCK_BYTES):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False)))
        flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        full = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(full).dictionary_encode()
        counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
        tokens = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(counts), 0)
        words = [b"", *coded.dictionary.cast(pa.large_binary()).to_pylist()]
        row = [[seq], [part.column(0).to_pylist()], [part.column(1).to_pylist()], [(counts + 1).tolist()], [_pack_words(words)], [pack(tokens)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [f.split()[0] for f in _BLOCKS.split(", ")])
        seq += 1


class Block:
    """A block's tokens, its distinct n-grams of each order, and the answers to what it asked.

    Of order m, ``gram[m]`` has each token's n-gram (-1: too near the text's begin), ``context[m]`` and ``word[m]`` its parts,
    ``asked[m]`` the order in which they were asked for and ``count[m]`` the training counts.
    """

    def __init__(self, row: dict, n_buckets: int):
        self.n_buckets = n_buckets
        self.sizes = np.array(row["sizes"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.trained = ~np.array(row["held"], bool)[self.doc]
        self.age = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.words = _unpack_words(row["words"])
        self.tokens = unpack(row["tokens"])
        self.gram, self.context, self.word, self.bucket, self.asked, self.ids, self.count, self.owned, self.total, self.weight = ({} for _ in range(10))
        self.gram[1] = self.tokens
        self.bucket[1] = np.fromiter((xxhash.xxh64_intdigest(w) % n_buckets for w in self.words), np.int64, len(self.words))
        self.asked[1] = np.argsort(self.bucket[1], kind="stable")

    def trained_counts(self, m: int, n: int) -> np.ndarray:
        here = self.trained & (self.gram[m] >= 0)
        return np.bincount(self.gram[m][here], minlength=n)

    def answer(self, m: int, ids: np.ndarray | None, counts: np.ndarray) -> None:
        """Counts (from order 2 on doubled, plus one where this block is the first to ask), in the order asked."""
        back = np.empty(len(counts), np.int64)
        back[self.asked[m]] = np.arange(len(counts))
        if ids is not None:
            self.ids[m] = ids[back]
        self.count[m] = counts[back] if m == 1 else counts[back] >> 1
        if m > 1:
            self.owned[m] = counts[back] & 1 > 0
            return
        # From here on words are numbered as in the corpus, so that n-grams come sorted.
        order = np.argsort(self.ids[1])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.tokens = self.gram[1] = rank[self.tokens]
        self.ids[1], self.count[1] = self.ids[1][order], self.count[1][order]

    def extend(self, m: int) -> None:
        """The n-grams of order m, from those of m - 1 with their ids."""
        at = np.flatnonzero(self.age >= m - 1)
        n_words = len(self.ids[1])
        key, inverse = np.unique(self.gram[m - 1][at - 1] * n_words + self.tokens[at], return_inverse=True)
        self.context[m], self.word[m] = key // n_words, key % n_words
        self.gram[m] = np.full(len(self.tokens), -1)
        self.gram[m][at] = inverse
        mixed = self.ids[m - 1][self.context[m]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ self.ids[1][self.word[m]].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.bucket[m] = ((mixed >> np.uint64(32)) % np.uint64(self.n_buckets)).astype(np.int64)
        self.asked[m] = np.argsort(self.bucket[m], kind="stable")

    def asked_contexts(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts of order m's n-grams, sorted by bucket, and the bucket of each."""
        contexts = np.unique(self.context[m])
        bucket = self.ids[m - 1][contexts] % self.n_buckets
        order = np.argsort(bucket, kind="stable")
        return contexts[order], bucket[order]

    def probabilities(self, upto: int, constants: list[tuple]) -> np.ndarray:
        """P of each token after the words before it in its text, ``upto`` - 1 of them at most."""
        d, total, unknown = constants[0]
        c = self.count[1][self.tokens]
        p = np.where(c > 0, _discounted(c, d) / total, unknown)
        for m in range(2, upto + 1):
            at = np.flatnonzero(self.gram[m] >= 0)
            g = self.gram[m][at]
            c, h = self.count[m][g], self.context[m][g]
            p[at] = np.where(c > 0, _discounted(c, constants[m - 1][0]) / self.total[m][h], self.weight[m][h] * p[at])
        return p


def _spans(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted buckets."""
    if len(bucket):
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield from zip(bucket[at].tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)


def _strung(rows: list[dict], column: str, read) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(read(x[column]) for x in rows)])


def _restored(row: dict, n_buckets: int, orders: int) -> Block:
    """A block with all answers that its row holds: orders up to ``orders``, and their contexts' weights as far as asked."""
    block = Block(row, n_buckets)
    for m in range(1, orders + 1):
        if m > 1:
            block.extend(m)
        # Of an order that no text of the block is long enough for, nothing was asked.
        found = sorted((x for x in row["answers"] or () if x["kind"] == f"count-{m}"), key=lambda x: x["bucket"])
        with_ids = not found or found[0]["a"] is not None
        block.answer(m, _strung(found, "a", unpack) if with_ids else None, _strung(found, "b", unpack))
        if m == 1:
            continue
        block.total[m], block.weight[m] = (np.ones(len(block.ids[m - 1])) for _ in range(2))
        weights = sorted((x for x in row["answers"] or () if x["kind"] == f"weight-{m}"), key=lambda x: x["bucket"])
        if weights:
            contexts, _ = block.asked_contexts(m)
            block.total[m][contexts], block.weight[m][contexts] = _strung(weights, "a", unpack), _strung(weights, "c", _unpack_floats)
    return block


def _asking(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.split()[0] for f in _ASKED.split(", ")])


def _each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


# Buckets


def _table_rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in _TABLES.split(", ")])


def _counted_words(n_buckets: int):
    def run(group: pa.Table) -> pa.Table:
        asked = group.sort_by("block").to_pylist()
        bucket = asked[0]["bucket"]
        lists = [_unpack_words(x["word"]) for x in asked]
        coded = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(counts, codes, np.concatenate([unpack(x["n"]) for x in asked]))
        # Frequent words get small numbers.
        order = np.argsort(-counts, kind="stable")
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order)) * n_buckets + bucket
        edges = np.cumsum([0, *map(len, lists)])
        out = [("count-1", bucket, x["block"], pack(ids[codes[s:e]]), pack(counts[codes[s:e]]), None, None) for x, s, e in zip(asked, edges[:-1], edges[1:], strict=True)]
        words = coded.dictionary.to_pylist()
        out.append(("grams-1", bucket, None, _pack_words([words[k] for k in order.tolist()]), pack(np.sort(ids)), pack(counts[order]), _stats(counts)))
        return _table_rows(out)

    return run


def _counted_grams(m: int, n_buckets: int, with_ids: bool):
    def run(group: pa.Table) -> pa.Table:
        asked = group.sort_by("block").to_pylist()
        bucket = asked[0]["bucket"]
        context, word, n = (np.concatenate([unpack(x[c]) for x in asked]) for c in ("context", "word", "n"))
        edges = np.cumsum([0, *(len(unpack(x["n"])) for x in asked)])
        order = np.lexsort((word, context))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (context[order[1:]] != context[order[:-1]]) | (word[order[1:]] != word[order[:-1]])
        codes = np.empty(len(order), np.int64)
        codes[order] = np.cumsum(fresh) - 1
        counts = np.zeros(int(fresh.sum()), np.int64)
        np.add.at(counts, codes, n)
        first = np.zeros(len(order), np.int64)
        first[order[fresh]] = 1  # lexsort is stable: the first to ask
        answers = counts[codes] * 2 + first
        ids = codes * n_buckets + bucket
        out = [(f"count-{m}", bucket, x["block"], pack(ids[s:e]) if with_ids else None, pack(answers[s:e]), None, None) for x, s, e in zip(asked, edges[:-1], edges[1:], strict=True)]
        seen = np.flatnonzero(counts)
        out.append((f"grams-{m}", bucket, None, pack(context[order[fresh]][seen], True), pack(word[order[fresh]][seen]), pack(counts[seen]), _stats(counts)))
        return _table_rows(out)

    return run


def _weighed(m: int):
    """A context's total and weight from what its seen words hold, free and have one order below."""

    def run(group: pa.Table) -> pa.Table:
        asked = group.sort_by("block").to_pylist()
        bucket = asked[0]["bucket"]
        contexts = [unpack(x["context"]) for x in asked]
        ids, codes = np.unique(np.concatenate(contexts), return_inverse=True)
        held = np.zeros(len(ids), np.int64)
        np.add.at(held, codes, np.concatenate([unpack(x["n"]) for x in asked]))
        freed, below = (np.bincount(codes, np.concatenate([_unpack_floats(x[c]) for x in asked]), len(ids)) for c in ("word", "more"))
        total = held + (freed <= 0)
        weight = np.where(held > 0, np.where(freed > 0, freed, 1.0) / total / (1 - below), 1.0)
        edges = np.cumsum([0, *map(len, contexts)])
        out = [(f"weight-{m}", bucket, x["block"], pack(total[codes[s:e]]), None, _pack_floats(weight[codes[s:e]]), None) for x, s, e in zip(asked, edges[:-1], edges[1:], strict=True)]
        seen = np.flatnonzero(held)
        out.append((f"weights-{m}", bucket, None, pack(ids[seen], True), pack(total[seen]), _pack_floats(weight[seen]), None))
        return _table_rows(out)

    return run


# The model


@dataclass
class KatzModel:
    """Blocks and the answered tables of each step; ``constants[m - 1]`` has order m's discounts, for order 1 also the total and the unknown word's share."""

    order: int
    n_buckets: int
    blocks: DataFrame
    steps: list[DataFrame]
    constants: list[tuple]
    train_tokens: int
    n_words: int

    def _rows(self, kind: str, run, schema: str) -> DataFrame:
        return map_arrow(_union([s.where(F.col("kind") == kind) for s in self.steps]), run, schema)

    def words(self) -> DataFrame:
        """(id, word, n): every word of the corpus with its training count; the end of a text is the empty word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _each_row(batches):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x["b"])), pa.array(_unpack_words(x["a"]), pa.binary()), pa.array(unpack(x["c"]))], ["id", "word", "n"])

        return self._rows("grams-1", run, "id long, word binary, n long")

    def grams(self, m: int) -> DataFrame:
        """(context, word, n): seen n-grams of order m by the ids of their context and last word."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _each_row(batches):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x[c])) for c in "abc"], ["context", "word", "n"])

        return self._rows(f"grams-{m}", run, "context long, word long, n long")

    def weights(self, m: int) -> DataFrame:
        """(context, total, weight): of seen contexts of order m's n-grams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _each_row(batches):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(x["a"])), pa.array(unpack(x["b"])), pa.array(_unpack_floats(x["c"]))], ["context", "total", "weight"])

        return self._rows(f"weights-{m}", run, "context long, total long, weight double")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _stored(rows: DataFrame, label: str) -> DataFrame:
    """Answers and model tables, partitioned by kind, in the shared folder."""
    path = fresh_path(rows.sparkSession, label)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _with_answers(written: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Blocks with the list of their answers."""
    each = _union([s.where("block IS NOT NULL").select("block", F.struct("kind", "bucket", "a", "b", "c").alias("answer")) for s in steps])
    return written.join(each.groupBy("block").agg(F.collect_list("answer").alias("answers")), "block")


def fit(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", held_out: str = "false") -> KatzModel:
    """The model of the rows of ``docs`` for which the SQL condition ``held_out`` isn't true, and all rows' blocks.

    Letters A-Z count as lower case, words are maximal stretches without ASCII white space, and each text has one more
    token, its end. A null or blank text has that only. Repeated rows count as often as they stand there. Only the named
    columns and those of ``held_out`` are read. A text must fit a task's memory, with about 100 bytes a word.
    """
    spark = docs.sparkSession
    ship(spark)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    written = settle(map_arrow(spread(chosen), _numbered, _BLOCKS), "katz-blocks")
    n_tokens = written.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_tokens // BUCKET_TOKENS + 1)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            block = Block(row, n_buckets)
            asked, counts = block.asked[1], block.trained_counts(1, len(block.words))[block.asked[1]]
            listed = [block.words[k] for k in asked.tolist()]
            yield _asking([(b, row["block"], None, _pack_words(listed[s:e]), pack(counts[s:e]), None) for b, s, e in _spans(block.bucket[1][asked])])

    steps = [_stored(map_arrow(written.select("block", "held", "sizes", "words", "tokens"), ask_words, _ASKED).groupBy("bucket").applyInArrow(_counted_words(n_buckets), _TABLES), "katz-words")]
    constants, stats = [], []
    for m in range(1, order + 1):
        if m > 1:
            steps.append(_stored(_asked_grams(written, steps, m, n_buckets).groupBy("bucket").applyInArrow(_counted_grams(m, n_buckets, m < order), _TABLES), f"katz-grams-{m}"))
        every = steps[-1].where(F.col("kind") == f"grams-{m}").select([F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(MOST_DISCOUNTED + 3)]).first()
        stats.append([int(x or 0) for x in every])
        d = discounts(stats[-1][2:])
        if m > 1:
            constants.append((d,))
            steps.append(_stored(_asked_weights(written, steps, m, n_buckets, constants).groupBy("bucket").applyInArrow(_weighed(m), _TABLES), f"katz-weights-{m}"))
            continue
        freed = sum((1 - d[r]) * r * stats[0][r + 1] for r in range(1, len(d)))
        total = stats[0][0] + (freed <= 0)
        constants.append((d, total, (freed if freed > 0 else 1.0) / total))
    return KatzModel(order, n_buckets, written, steps, constants, stats[0][0], stats[0][1])


def _asked_grams(written: DataFrame, steps: list[DataFrame], m: int, n_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            block = _restored(row, n_buckets, m - 1)
            block.extend(m)
            asked = block.asked[m]
            counts = block.trained_counts(m, len(asked))[asked]
            context, word = block.ids[m - 1][block.context[m]][asked], block.ids[1][block.word[m]][asked]
            yield _asking([(b, row["block"], pack(context[s:e], True), pack(word[s:e]), pack(counts[s:e]), None) for b, s, e in _spans(block.bucket[m][asked])])

    return map_arrow(_with_answers(written.drop("doc_ids"), steps), run, _ASKED)


def _asked_weights(written: DataFrame, steps: list[DataFrame], m: int, n_buckets: int, constants: list[tuple]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            block = _restored(row, n_buckets, m)
            contexts, bucket = block.asked_contexts(m)
            if not len(contexts):
                continue
            # Each n-gram counts where it was asked for first; its word's P one order below is that of any of its places.
            mine = np.flatnonzero(block.owned[m] & (block.count[m] > 0))
            place = np.empty(len(block.word[m]), np.int64)
            at = np.flatnonzero(block.gram[m] >= 0)
            place[block.gram[m][at]] = at
            c, h = block.count[m][mine], block.context[m][mine]
            n = len(block.ids[m - 1])
            held = np.bincount(h, c, n).astype(np.int64)[contexts]
            freed = np.bincount(h, c - _discounted(c, constants[m - 1][0]), n)[contexts]
            below = np.bincount(h, block.probabilities(m - 1, constants)[place[mine]], n)[contexts]
            ids = block.ids[m - 1][contexts]
            yield _asking([(b, row["block"], pack(ids[s:e], True), _pack_floats(freed[s:e]), pack(held[s:e]), _pack_floats(below[s:e])) for b, s, e in _spans(bucket)])

    return map_arrow(_with_answers(written.drop("doc_ids"), steps), run, _ASKED)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(model: KatzModel) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row that the model's blocks hold.

    score: log10 of the text's probability; base_score: the same by single words with one added to each count, unknown ones
    included. train_tokens is the training tokens' number; without any, all words are unknown and have probability 1.
    """
    n_buckets, order, constants, n, v = model.n_buckets, model.order, model.constants, model.train_tokens, model.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each_row(batches):
            block = _restored(row, n_buckets, order)
            c = block.count[1][block.tokens]
            many = len(block.sizes)
            logs = np.log10(block.probabilities(order, constants))
            base = np.log10((c + 1) / (n + v + 1))
            columns = [
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(block.sizes), pa.array(np.bincount(block.doc[c > 0], minlength=many)),
                pa.array(np.full(many, n)), pa.array(np.bincount(block.doc, base, many)), pa.array(np.bincount(block.doc, logs, many)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORES.split(", ")])

    return map_arrow(_with_answers(model.blocks, model.steps), run, _SCORES)


#: The fold that the model doesn't learn from. A null id is in none.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"


def op11_katz_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(fit(table(spark, sf_dir, "documents"), held_out=HELD_OUT))
