"""Periodic runs of words by the runs theorem.

A run is a maximal stretch of words with smallest period p that holds its period at least ``LEAST_TIMES`` times. The
theorem: with an end mark below all words, each run has a Lyndon root, a conjugate of its period, that is the longest
Lyndon word from its first word on, under the order of words or under the reversed one. Those longest Lyndon words end
before the next position whose suffix is smaller: the next smaller value of the inverse suffix array, and with the
order reversed the next greater one, as the end mark makes all suffixes differ before they end. So 2n candidates hold
every root. Each is extended to both sides by longest common extensions: range minima over the LCP array, in a sparse
table of which one level is held at a time; to the left by the same on the reversed words. What is not long enough for
a run is dropped before the costlier steps.

Spark deals the documents out. A task works on blocks of whole texts, all suffixes of a block in one sort with the
document as the first key; memory is about 60 bytes a word of a block, and a block is 2 MB or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import map_arrow, spread
from stratum.sources.tables import table

LEAST_WORDS = 24
LEAST_TIMES = 3
_NEAR = 8


def suffix_ranks(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inverse suffix array. ``codes``: words from 1 on, and a 0 after each document, at ``ends``; suffixes end with
    their document and are ordered by document first. Prefix doubling over what is still tied."""
    n = len(codes)
    doc = np.zeros(n, np.int64)
    doc[ends[:-1] + 1] = 1
    np.cumsum(doc, out=doc)
    most = int(codes.max()) + 1
    key = doc * most + codes
    h = 1
    if (int(doc[-1]) + 1) * most * most < 1 << 62:
        follow = np.zeros(n, np.int64)
        follow[:-1] = codes[1:]
        follow[ends] = 0
        key, h = key * most + follow, 2
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    tied = order[~alone]
    while len(tied):
        # Suffixes tied in h words hold no end mark among them, so i + h is in their document.
        group = rank[tied]
        key = group * n + rank[tied + h]
        order = np.argsort(key, kind="stable")
        tied, key, group = tied[order], key[order], group[order]
        at = np.arange(len(tied))
        fresh, opens = np.ones(len(tied), bool), np.ones(len(tied), bool)
        fresh[1:], opens[1:] = key[1:] != key[:-1], group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[tied] = group + first - np.maximum.accumulate(np.where(opens, at, 0))
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        tied = tied[~alone]
        h *= 2
    return rank


def next_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the next with a smaller value, len(v) where none is: near ones by looking, others over a tree of minima."""
    n = len(v)
    out, open_ = np.full(n, n), np.arange(n)
    for d in range(1, _NEAR + 1):
        open_ = open_[: np.searchsorted(open_, n - d)]
        below = v[open_ + d] < v[open_]
        out[open_[below]] = open_[below] + d
        open_ = open_[~below]
    levels = [v]
    while len(levels[-1]) > 1:
        low = levels[-1]
        if len(low) % 2:
            low = np.append(low, np.iinfo(low.dtype).max)
        levels.append(np.minimum(low[::2], low[1::2]))
    node = open_ + _NEAR + 1
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for k, low in enumerate(levels):
        for turn in (0, 1):
            inside = node < len(low)
            open_, node = open_[inside], node[inside]
            # At most two nodes a level: this one, and its right neighbour if that is a right child.
            look = np.ones(len(node), bool) if turn == 0 else node % 2 == 1
            hit = look.copy()
            hit[look] = low[node[look]] < v[open_[look]]
            found.append((k, open_[hit], node[hit]))
            open_, node = open_[~hit], node[~hit] + look[~hit]
        node = node >> 1
        if not len(open_):
            break
    for k, who, node in found:
        while k:
            k -= 1
            node = node * 2
            node += levels[k][node] >= v[who]
        out[who] = node
    return out


def lcp_of(codes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """LCP[r]: common words of the suffixes ranked r - 1 and r. Irreducible values are compared, whose sum is at most
    n log n; the others are one less than that of the place before."""
    n = len(codes)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    above = np.empty(n, np.int64)
    above[order[1:]] = order[:-1]
    above[order[0]] = order[0]
    left = np.concatenate([[0], codes[:-1]])
    own = (left != left[above]) | (left == 0)
    size = np.zeros(n, np.int64)
    live = np.flatnonzero(own & (codes != 0))
    depth = 0
    while len(live) > 256 or (len(live) and depth < 64):
        same = codes[live + depth] == codes[above[live] + depth]
        size[live[~same]] = depth
        live = live[same]
        depth += 1
    for i in live.tolist():
        j, at, step = int(above[i]), depth, 256
        while True:
            x, y = codes[i + at : i + at + step], codes[j + at : j + at + step]
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            if len(differ):
                size[i] = at + int(differ[0])
                break
            at, step = at + m, step * 2
    last = np.maximum.accumulate(np.where(own | (codes == 0), np.arange(n), 0))
    whole = size[last] - (np.arange(n) - last)
    return whole[order]


def common_words(rank: np.ndarray, lcp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common extension to the right of places i and j: minima over ranges of the LCP array, by a sparse table, a level at a time."""
    a, b = np.minimum(rank[i], rank[j]) + 1, np.maximum(rank[i], rank[j])
    out = np.zeros(len(i), np.int64)
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    held = lcp
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            held = np.minimum(held[:-half], held[half:])
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(held[a[mine]], held[b[mine] - (1 << k) + 1])
    return out


def _taken(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents with their end marks, backward if asked, and where each begins."""
    sizes = ends[docs] - starts[docs] + 1
    first = np.concatenate([[0], np.cumsum(sizes)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], sizes)
    if not backward:
        return codes[np.repeat(starts[docs], sizes) + within], first
    at = np.repeat(ends[docs], sizes) - 1 - within
    out = codes[np.maximum(at, 0)]
    out[first[1:] - 1] = 0
    return out, first


def find_runs(codes: np.ndarray, counts: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (document, start, length, period), in this order, of every run of at least ``least`` words and ``times`` periods.

    codes: the words of all documents as numbers from 1 on, equal for equal words; counts: words of each document.
    ``times`` is 2 or more.
    """
    if times < 2:
        raise ValueError("a run holds its period twice at least")
    chosen = np.flatnonzero(counts >= max(least, times))
    if not len(chosen):
        return np.zeros((0, 4), np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    sizes = counts[chosen] + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - counts[chosen]
    marked = np.zeros(int(ends[-1]) + 1, np.int64)
    words = np.ones(len(marked), bool)
    words[ends] = False
    marked[words] = codes[np.repeat(bounds[chosen], counts[chosen]) + np.arange(int(counts[chosen].sum())) - np.repeat(np.cumsum(counts[chosen]) - counts[chosen], counts[chosen])]
    rank = suffix_ranks(marked, ends)
    end_of = np.repeat(ends, sizes)
    places, periods = [], []
    for value in (rank, -rank):
        i = np.flatnonzero(words)
        p = next_smaller(value)[i] - i
        # A run's first root begins within its first period, so that much must agree to the right of it.
        most = np.maximum(least - 2 * p, (times - 2) * p)
        held = i + p + most < end_of[i]
        i, p, most = i[held], p[held], most[held]
        for part in (0, 1, 2, 3):
            offset = most // part if part else 0
            same = marked[i + offset] == marked[i + p + offset]
            i, p, most = i[same], p[same], most[same]
        places.append(i)
        periods.append(p)
    i, p = np.concatenate(places), np.concatenate(periods)
    if not len(i):
        return np.zeros((0, 4), np.int64)
    doc = np.searchsorted(ends, i)
    # To the right, in the documents that have a candidate.
    some, sub = np.unique(doc, return_inverse=True)
    own, first = _taken(marked, starts, ends, some)
    ranks = suffix_ranks(own, first[1:] - 1)
    at = i - starts[doc] + first[sub]
    right = common_words(ranks, lcp_of(own, ranks), at, at + p)
    held = right > np.maximum(least - 2 * p, (times - 2) * p)
    i, p, doc, right = i[held], p[held], doc[held], right[held]
    if not len(i):
        return np.zeros((0, 4), np.int64)
    # To the left, on the reversed words of those that still have one.
    some, sub = np.unique(doc, return_inverse=True)
    own, first = _taken(marked, starts, ends, some, backward=True)
    ranks = suffix_ranks(own, first[1:] - 1)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > starts[doc])
    at = first[sub[inner]] + ends[doc[inner]] - i[inner]
    left[inner] = common_words(ranks, lcp_of(own, ranks), at, at - p[inner])
    length = left + p + right
    keep = length >= np.maximum(least, times * p)
    rows = np.stack([chosen[doc], i - left - starts[doc], length, p], axis=1)[keep]
    return np.unique(rows[:, [0, 1, 3, 2]], axis=0)[:, [0, 1, 3, 2]]


def word_codes(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of the texts, the number of each (equal for equal words, from 1 on), and how many each text has."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string(), safe=False))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    return flat, flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.bincount(owner, minlength=len(texts))


def _joined(words: pa.Array, counts: np.ndarray) -> pa.Array:
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) of every row.

    runs: array of (start, length, period) in words, by start, then period: each stretch of consecutive words with this
    smallest period, of at least ``least`` words and ``times`` periods, that no word beside it extends. Words are
    maximal stretches without ASCII white space, compared byte for byte. collapsed: the words, joined by one space, without
    those that any run holds after its first period. A null or blank text has no words, no runs and an empty collapsed
    text. Repeated rows each get a row; only the named columns are read. A text must fit a task's memory, see above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            words, codes, counts = word_codes(texts)
            rows = find_runs(codes, counts, least, times)
            doc, start, length, period = rows.T
            first = np.concatenate([[0], np.cumsum(counts)])
            change = np.zeros(len(codes) + 1, np.int64)
            np.add.at(change, first[doc] + start + period, 1)
            np.add.at(change, first[doc] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.bincount(np.repeat(np.arange(len(texts)), counts)[kept], minlength=len(texts))
            edges = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))]).astype(np.int32))
            lists = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], names=["start", "length", "period"]))
            collapsed = _joined(words.filter(pa.array(kept)), left).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), lists, collapsed], ["doc_id", "runs", "collapsed"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_arrow(spread(chosen), run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in one of ten documents, told by the checksum of the id, the words from a place on become periodic.

    A null id plants nothing. DataFrame functions only.
    """
    # split() gives an empty first or last word for white space at the ends.
    words = F.expr("filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    split = hashed.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    placed = split.withColumn("a", F.expr("if(n > 0, g % n, 0L)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, periodic).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of (doc_id, runs, collapsed)."""
    longer = "l.length * r.period > r.length * l.period"
    earlier = "(l.length * r.period = r.length * l.period and (l.start < r.start or (l.start = r.start and l.period < r.period)))"
    best = found.withColumn("best", F.expr(f"aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (r, l) -> if(r is null or {longer} or {earlier}, l, r))"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))
