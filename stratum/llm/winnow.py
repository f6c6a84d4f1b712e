"""Benchmark decontamination by winnowing.

Texts are words; a fingerprint is the smallest hash among the ``k``-grams of a sliding window of
``span - k + 1`` of them. Two texts that share ``span`` words pick the same fingerprint at the same
place inside that span, so joining the fingerprints of documents and items loses no shared span. A hit
is extended to both sides through the windows of ``span`` words that hold the fingerprint: each is
looked up among the items' distinct windows, which know the items they stand in. So a hit costs
``span - k + 1`` lookups however often its words repeat in the document or the items, and no pairs of
places are made. Longer shared spans are unions of such windows. An item of fewer words is a window of
its own and is looked up whole, for each length that occurs. Words are numbered by the items' vocabulary,
byte for byte, and found windows are compared number by number, so no hash can lose or make a link.

The items that have words are sent to the workers in blocks of about ``INDEX_BYTES``, each item counted with its
text, its id and ``ITEM_BYTES``, so what is broadcast has a bound however large the benchmark is and whatever
its items are; the documents are read once for each block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import map_arrow, settle
from stratum.sources.tables import table

SPAN = 10
GRAM = 5
INDEX_BYTES = 8 << 20
#: What an item costs besides its text and id.
ITEM_BYTES = 64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WORD = np.array([b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_HAS_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_STEPS = [(2 * i + 1) * 0xD1342543DE82EF95 % (1 << 64) | 1 for i in range(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of many texts as numbers: equal words, compared byte for byte, have one number, words that ``known`` lacks 0.

    Without ``known`` all words are numbered from 1 on, and ``known`` is made.
    """

    def __init__(self, texts: list[bytes], known: dict[bytes, int] | None = None):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        raw = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        inside = _WORD[raw]
        n = len(raw)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges[:-1][edges[:-1] < n]] = False
        after[edges[1:][edges[1:] > 0] - 1] = False
        begins, lengths = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        lengths -= begins
        self.text_of = np.searchsorted(edges, begins, "right") - 1
        self.counts = np.bincount(self.text_of, minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        packed = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
        distinct = packed.dictionary.to_pylist()
        self.known = {w: i + 1 for i, w in enumerate(distinct)} if known is None else known
        self.codes = np.fromiter((self.known.get(w, 0) for w in distinct), np.int32, len(distinct))[packed.indices.to_numpy(zero_copy_only=False)]

    def grams(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each place, and whether they are of one text."""
        n = max(0, len(self.codes) - k + 1)
        mixed = _mix(self.codes.astype(np.uint64) + np.uint64(salt << 32))
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out += mixed[j : j + n] * np.uint64(_STEPS[j])
        return _mix(out), self.text_of[:n] == self.text_of[k - 1 : k - 1 + n]

    def winnowed(self, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the k-grams that are smallest in a window, the last of equals."""
        grams, _ = self.grams(k)
        width = span - k + 1
        n = max(0, len(self.codes) - span + 1)
        full = self.text_of[:n] == self.text_of[span - 1 : span - 1 + n]
        best, place = grams[:n].copy(), np.arange(n)
        for j in range(1, width):
            other = grams[j : j + n]
            take = other <= best
            best[take] = other[take]
            place[take] = np.flatnonzero(take) + j
        chosen = np.unique(place[full])
        return chosen, grams[chosen]


class Windows:
    """The distinct windows of one length of all items: sorted hashes, a place of each, and the set of items it stands in.

    Windows are told apart by their words. Those whose hash another one has are in a further table by another hash.
    """

    def __init__(self, words: Words, length: int, places: np.ndarray, salt: int = 0):
        self.length, self.salt = length, salt
        hashes = words.grams(length, salt)[0][places]
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = hashes[1:] != hashes[:-1]
        self.hashes, self.places = hashes[fresh], places[fresh]
        window = np.cumsum(fresh) - 1
        same = np.ones(len(places), bool)
        for j in range(length):
            same &= words.codes[places + j] == words.codes[self.places[window] + j]
        self.further = None if same.all() else Windows(words, length, np.sort(places[~same]), salt + 1)
        pairs = np.unique(np.stack([window, words.text_of[places]], axis=1)[same], axis=0)
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])) if len(pairs) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(pairs))
        sets: dict[bytes, int] = {}
        self.set_of = np.zeros(len(self.hashes), np.int64)
        chosen, members = [], np.ascontiguousarray(pairs[:, 1])
        for w, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            at = sets.setdefault(members[s:e].tobytes(), len(sets))
            if at == len(chosen):
                chosen.append((s, e))
            self.set_of[w] = at
        self.set_ends = np.cumsum([0, *(e - s for s, e in chosen)])
        self.members = np.concatenate([np.zeros(0, np.int64), *(members[s:e] for s, e in chosen)])

    def items_of(self, which: int) -> list[int]:
        return self.members[self.set_ends[which] : self.set_ends[which + 1]].tolist()

    def find(self, items: Words, words: Words, places: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """Of places of whole windows in ``words``: those whose window is an item's, and which window of which table."""
        hashes = words.grams(self.length, self.salt)[0][places]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        held = np.flatnonzero(self.hashes[at] == hashes)
        found, at = places[held], at[held]
        for j in range(self.length):
            same = words.codes[found + j] == items.codes[self.places[at] + j]
            found, at = found[same], at[same]
        yield self, found, at
        if self.further is not None:
            yield from self.further.find(items, words, places)


class Index:
    """Winnowed fingerprints and windows of items with ``span`` words or more; whole shorter items by length."""

    def __init__(self, items: list[tuple[str | None, bytes]], k: int = GRAM, span: int = SPAN):
        self.k, self.span = k, span
        self.ids = [i for i, _ in items]
        self.words = Words([t for _, t in items])
        self.known = self.words.known
        first = np.concatenate([[0], np.cumsum(self.words.counts)])
        self.fingerprints = np.unique(self.words.winnowed(k, span)[1])
        self.windows = []
        for m in range(1, span + 1):
            places = np.flatnonzero(self.words.grams(span)[1]) if m == span else first[:-1][self.words.counts == m]
            if len(places):
                self.windows.append(Windows(self.words, m, places))

    def _extended(self, words: Words) -> np.ndarray:
        """Places of the windows of ``span`` words that hold a fingerprint which is also an item's."""
        places, hashes = words.winnowed(self.k, self.span)
        if not len(places):
            return places
        at = np.minimum(np.searchsorted(self.fingerprints, hashes), len(self.fingerprints) - 1)
        places = places[self.fingerprints[at] == hashes]
        around = np.unique(places[:, None] - np.arange(self.span - self.k + 1))
        around = around[(around >= 0) & (around <= len(words.codes) - self.span)]
        return around[words.text_of[around] == words.text_of[around + self.span - 1]]

    def search(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items of each text that has any. ``words`` are numbered by ``known``."""
        change, found = np.zeros(len(words.codes) + 1, np.int64), {}
        for table_ in self.windows:
            m = table_.length
            if m == self.span:
                candidates = self._extended(words)
            else:
                candidates = np.flatnonzero(words.grams(m)[1])
            if not len(candidates):
                continue
            for held, places, which in table_.find(self.words, words, candidates):
                np.add.at(change, places, 1)
                np.add.at(change, places + m, -1)
                for text, members in np.unique(np.stack([words.text_of[places], held.set_of[which]], axis=1), axis=0).tolist():
                    found.setdefault(text, set()).update(held.items_of(members))
        return np.cumsum(change[:-1]) > 0, found


_indexes: dict[str, Index] = {}


def _index_of(name: str, shared) -> Index:
    """The worker's index of the broadcast items; it keeps one, for the tasks that follow."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(shared.value)
    return _indexes[name]


_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _item_blocks(items: DataFrame, most: int) -> tuple[int, Iterator[list[tuple[str | None, bytes]]]]:
    """The distinct items with words in blocks of about ``most`` bytes, by a hash of both columns, each collected by itself, and how many blocks."""
    typed = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    chosen = settle(typed.where(F.col("text").rlike(_HAS_WORD)).withColumn("text", F.encode("text", "utf-8")).distinct(), "items")
    total = chosen.agg(F.sum(F.length("text") + F.coalesce(F.length("item_id"), F.lit(0)) + ITEM_BYTES)).first()[0] or 0
    n = 1 if total <= most else int(2 * total // most) + 1

    def each() -> Iterator[list[tuple[str | None, bytes]]]:
        for k in range(n):
            rows = chosen if n == 1 else chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield [(r.item_id, bytes(r.text)) for r in rows.toLocalIterator()]

    return n, each()


def _chosen(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _scan(docs: DataFrame, id_col: str, text_col: str, items: list[tuple[str | None, bytes]]) -> DataFrame:
    """Final rows against items that one index holds."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, shared)
        for part, texts in blocks(batches, "text"):
            words = Words(texts, index.known)
            hit, found = index.search(words)
            n_hit = np.bincount(words.text_of[hit], minlength=len(texts))
            ids = [{index.ids[j] for j in found.get(i, ())} - {None} for i in range(len(texts))]
            fresh = [pa.array(words.counts), pa.array(n_hit), pa.array([len(x) for x in ids], pa.int64()), pa.array([_digest(x) for x in ids]), pa.array(n_hit > 0)]
            yield pa.RecordBatch.from_arrays([part.column(0), *fresh], ["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))])

    return map_arrow(_chosen(docs, id_col, text_col), run, f"doc_id long, {_FIELDS}")


def _scan_hits(docs: DataFrame, id_col: str, text_col: str, items: list[tuple[str | None, bytes]]) -> DataFrame:
    """For documents with hits only: their key, the places of hit words and the items' ids."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, shared)
        for part, texts in blocks(batches, "text"):
            words = Words(texts, index.known)
            hit, found = index.search(words)
            first = np.concatenate([[0], np.cumsum(words.counts)])
            rows = sorted(found)
            places = [np.flatnonzero(hit[first[i] : first[i + 1]]).tolist() for i in rows]
            keys = [hashlib.sha256(texts[i]).hexdigest() for i in rows]
            ids = [sorted({index.ids[j] for j in found[i]} - {None}) for i in rows]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), pa.array(places, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "key", "hits", "ids"])

    return map_arrow(_chosen(docs, id_col, text_col), run, "doc_id long, key string, hits array<long>, ids array<string>")


def _word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()), pa.array(Words(texts, {}).counts)], ["doc_id", "key", "n_words"])

    return map_arrow(_chosen(docs, id_col, text_col), run, "doc_id long, key string, n_words long")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``.

    Null texts have no words. Items without words match nothing. A null item_id's item hits words but
    is not counted among the items; equal item_ids count once. Repeated documents each get a row.
    No items: no hits. Only the named columns are read, so other columns' names cannot clash.
    """
    n, parts = _item_blocks(items, index_bytes)
    if n == 1:
        return _scan(docs, id_col, text_col, next(parts))
    # More items than a worker should hold: hits of each block, then their union for each document that has any.
    found = None
    for part in parts:
        hits = settle(_scan_hits(docs, id_col, text_col, part))
        found = hits if found is None else found.unionByName(hits)
    each = found.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    sized = _word_counts(docs, id_col, text_col)
    joined = sized.join(each.withColumnsRenamed({"doc_id": "d", "key": "k"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_only(docs: DataFrame, items: DataFrame, text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no word is hit: each block of items filters what the one before left."""
    _, parts = _item_blocks(items, index_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for part in parts:
        shared, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index_of(name, shared)
            for rows, texts in blocks(batches, text_col):
                words = Words(texts, index.known)
                hit, _ = index.search(words)
                yield rows.filter(pa.array(np.bincount(words.text_of[hit], minlength=len(texts)) == 0))

        docs = map_arrow(docs, run, schema)
    return docs


_WORDS_SQL = """list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: length(w) > 0)"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS m, array_to_string(list_slice(w, i, i + least(len(w), {SPAN}) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SPAN} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT dw.rid, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items,
       coalesce(ids.h, sha256('')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN ids USING (rid)
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
