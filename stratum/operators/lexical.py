"""BM25 over analysed passages: terms, lengths, document frequencies, vectors and top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions import text as T
from stratum.runtime import map_arrow, settle, spread

#: Terms of all queries that may be sent to every executor.
MOST_BROADCAST = 1_000_000
#: Rows of best passages that tasks may give without a floor, and the share of passages from which floors are taken.
MOST_UNBOUNDED, FLOOR_SHARE = 4_000_000, 4


def as_terms(tokens: DataFrame, token: str) -> DataFrame:
    """Adds ``term`` and leaves out stopwords. The same as ``text.term``, but each step's patterns run only on words with its ending."""
    t = F.col(token)
    whole = t.startswith("=")
    word = F.when(whole, F.lower(F.substring(t, 2, 1 << 20))).when(t.endswith("s"), F.lower(F.regexp_replace(t, r"^(\p{Lu}{2,})s$", "$1"))).otherwise(F.lower(t))
    out = tokens.withColumns({"__whole": whole, "term": word}).where(F.col("__whole") | ~F.col("term").isin(*sorted({*T.ENGLISH, *T.FRENCH})))
    # Steps are mapped over an array of the one word, which binds it: a chain of columns would be one method too deep to compile.
    stemmed = "array(term)"
    for endings, body in T.stem_steps():
        ends = " OR ".join(f"endswith(w, '{e}')" for e in endings)
        stemmed = f"transform({stemmed}, w -> CASE WHEN ({ends}) AND NOT w rlike r'\\p{{N}}' THEN {body.replace('{w}', 'w')} ELSE w END)"
    return out.withColumn("term", F.expr(f"CASE WHEN __whole OR NOT term rlike r'(?:[sxey]|ed|ing|er)$' THEN term ELSE {stemmed}[0] END")).drop("__whole")


def term_frequencies(passages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): length counts all terms of the passage, repeats included. Passages without terms give no rows."""
    # An inner explode would be preceded by a filter that cuts the text once more.
    cut = spread(passages.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.explode_outer(F.expr(T.chunks(T.fold(text_col)))).alias("c")).where("c IS NOT NULL")
    # Dealt out by passage once: counts and lengths then need no further shuffle.
    terms = as_terms(cut.select("id", F.explode_outer(F.expr(T.chunk_tokens("c"))).alias("t")).where("t IS NOT NULL"), "t").select("id", "term").repartition("id")
    counts = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.withColumn("length", F.sum("tf").over(Window.partitionBy("id")))


def average_length(frequencies: DataFrame, passages: DataFrame) -> DataFrame:
    """(passages, average_length) over all passages, those without terms too; 0 if there are none."""
    terms = frequencies.agg(F.sum("tf").alias("terms"))
    n = passages.agg(F.count(F.lit(1)).alias("passages"))
    return n.crossJoin(terms).select("passages", F.coalesce(F.try_divide(F.col("terms").cast("double"), "passages"), F.lit(0.0)).alias("average_length"))


def term_statistics(frequencies: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf): idf is ln(1 + (N - df + 0.5) / (df + 0.5))."""
    df = frequencies.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n.select("passages")), how="cross").select("term", "df", F.log(1 + (F.col("passages") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def sparse_vectors(frequencies: DataFrame, average: DataFrame) -> DataFrame:
    """(id, token_id, weight): colliding terms' weights add up; weights are single precision."""
    weighted = frequencies.join(F.broadcast(average), how="cross").select("id", F.expr(T.token_id("term")).alias("token_id"), F.expr(T.tf_weight("tf", "length", "average_length")).alias("w"))
    return weighted.groupBy("id", "token_id").agg(F.sum("w").cast("float").alias("weight"))


def bm25_topk(passages: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 10) -> DataFrame:
    """(query_id, id, score, rank): the k best passages of each query; each distinct query term counts once; ties by id.

    Passages are analysed once and written, a row each. The queries' terms with their weights are sent to all workers, in
    blocks by a hash of query_id where there are over ``MOST_BROADCAST`` of them, each block's result a table of its own.
    """
    wanted = settle(term_frequencies(queries, query_id, query_text).select(F.col("id").alias("query_id"), "term"), "query-terms")
    listed = term_frequencies(passages, id_col, text_col).groupBy("id").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "tf")).alias("terms"))
    held = settle(listed, "frequencies")
    terms = held.agg(F.sum("length").alias("terms"))
    average = passages.agg(F.count(F.lit(1)).alias("passages")).crossJoin(terms).select("passages", F.coalesce(F.try_divide(F.col("terms").cast("double"), "passages"), F.lit(0.0)).alias("average_length"))
    average = settle(average, "average", 1)
    n = wanted.count()
    asked = wanted.select("term").distinct()
    relevant = held.select(F.explode("terms.term").alias("term")).join(F.broadcast(asked) if n <= MOST_BROADCAST else asked, "term", "left_semi")
    weights = settle(term_statistics(relevant, average).select("term", "idf"), "term-weights")
    length = average.first()["average_length"]
    if n <= MOST_BROADCAST:
        return _best(held, wanted, weights, length, k)
    # Blocks of half the bound, as a hash doesn't deal evenly.
    count = -(-2 * n // MOST_BROADCAST)
    block = F.pmod(F.xxhash64("query_id"), F.lit(count))
    return reduce(DataFrame.unionByName, [settle(_best(held, wanted.where(block == i), weights, length, k), "lexical-block") for i in range(count)])


def _best(held: DataFrame, wanted: DataFrame, weights: DataFrame, average: float, k: int) -> DataFrame:
    """The k best passages (id, length, terms) of each query of ``wanted`` (query_id, term).

    Each batch of passages gives its best k of a query. Where that may be many rows a share of the passages is scored before: the
    k-th best score among some passages is not above the k-th best of all, so what is below it is left out where it is scored.
    """
    import numpy as np
    import pyarrow.compute as pc

    spark = held.sparkSession
    told = weights.join(wanted.select("term").distinct(), "term", "left_semi").toArrow()
    rows = wanted.join(weights, "term", "left_semi").toArrow()
    vocabulary, idf = told.column("term").combine_chunks(), told.column("idf").to_numpy()
    numbers = rows.column("query_id").combine_chunks().dictionary_encode()
    keys, of = numbers.dictionary, numbers.indices.to_numpy(zero_copy_only=False)
    term = pc.index_in(rows.column("term").combine_chunks(), value_set=vocabulary).to_numpy(zero_copy_only=False)
    term = term[np.lexsort((term, of))]
    begins = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(keys)))]).astype(np.int64)
    shared = spark.sparkContext.broadcast((vocabulary, idf, keys, term, begins))
    kinds = {"query_id": wanted.schema["query_id"].dataType.simpleString(), "id": held.schema["id"].dataType.simpleString()}

    def scored(rows: DataFrame, most: int, floors: dict) -> DataFrame:
        low = spark.sparkContext.broadcast(np.array([floors.get(key, 0.0) for key in keys.to_pylist()]))
        run = lambda batches: score_batches(batches, shared.value, low.value, average, most)
        return map_arrow(rows, run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    dealt, floors = spread(held), {}
    tasks = dealt.rdd.getNumPartitions()
    if tasks * len(keys) * k > MOST_UNBOUNDED:
        some = dealt.where(F.pmod(F.xxhash64("id"), F.lit(FLOOR_SHARE)) == 0).coalesce(-(-tasks // FLOOR_SHARE))
        tops = scored(some, -(-2 * k // -(-tasks // FLOOR_SHARE)), {}).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
        least = tops.where(F.size("s") >= k).select("query_id", F.col("s")[k - 1].alias("floor")).toArrow()
        floors = dict(zip(least.column("query_id").to_pylist(), least.column("floor").to_pylist(), strict=True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored(dealt, k, floors).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def score_batches(batches: Iterable, asked: tuple, floors: Any, average: float, most: int) -> Iterator:
    """(query_id, id, score) of each batch's best ``most`` passages of each query, ties by id, none under the query's floor.

    A batch's weights lie sorted by term, so a query's score is a sum over the slices of its terms; scores of one query are held at once.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    vocabulary, idf, keys, terms, begins = asked
    names = ["query_id", "id", "score"]
    for batch in batches:
        # In order of ids, so that of equal scores the first ones stay.
        table = pa.table(batch.columns, names=batch.schema.names)
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_start")).combine_chunks()
        ids, length, lists = (table.column(c).chunk(0) if table.num_rows else None for c in ("id", "length", "terms"))
        if not table.num_rows:
            continue
        flat = lists.flatten().flatten()
        number = pc.fill_null(pc.index_in(flat[0], value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(number >= 0)
        known = known[np.argsort(number[known], kind="stable")]
        doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))[known]
        tf, number = flat[1].to_numpy(zero_copy_only=False)[known].astype(float), number[known]
        weight = idf[number] * (tf * (T.K1 + 1) / (tf + T.K1 * (1 - T.B + T.B * length.to_numpy(zero_copy_only=False)[doc] / average)))
        first = np.searchsorted(number, np.arange(len(vocabulary) + 1))
        out, held = [], 0
        for q in range(len(keys)):
            mine = terms[begins[q] : begins[q + 1]]
            slices = [slice(a, b) for a, b in zip(first[mine].tolist(), first[mine + 1].tolist(), strict=True) if b > a]
            if not slices:
                continue
            score = np.bincount(np.concatenate([doc[s] for s in slices]), np.concatenate([weight[s] for s in slices]), len(ids))
            at = np.flatnonzero(score >= floors[q] - 1e-6 if floors[q] > 0 else score > 0)
            value = np.floor(score[at] * 1e6 + 0.5) / 1e6
            if floors[q] > 0:
                at, value = at[value >= floors[q]], value[value >= floors[q]]
            if len(at) > most:
                least = np.partition(value, len(value) - most)[len(value) - most]
                above = value > least
                above[np.flatnonzero(value == least)[: most - np.count_nonzero(above)]] = True
                at, value = at[above], value[above]
            if len(at):
                out.append((q, at, value))
                held += len(at)
            if held > 1 << 18:
                yield _hits(out, keys, ids, names)
                out, held = [], 0
        if out:
            yield _hits(out, keys, ids, names)


def _hits(out: list[tuple], keys: Any, ids: Any, names: list[str]) -> Any:
    import numpy as np
    import pyarrow as pa

    of = np.repeat([q for q, _, _ in out], [len(at) for _, at, _ in out])
    return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), ids.take(pa.array(np.concatenate([at for _, at, _ in out]))), pa.array(np.concatenate([v for _, _, v in out]))], names)
