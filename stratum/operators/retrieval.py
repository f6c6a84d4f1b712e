"""Routes, fusion and rank policies. Rankings are (query_id, chunk_id, score or position); positions count from 0, ranks from 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stratum.functions.text import prompt_form
from stratum.runtime import map_arrow, settle

#: Routes in the order in which their shares are added up.
ROUTES = ("dense_intent", "lexical_intent", "dense", "lexical", "identifier", "structured")
RRF_K, POOL, ROUTE_LIMIT, IDENTIFIER_LIMIT, RERANK_DEPTH = 60, 120, 100, 20, 30
TIE = 1e-5
MOST_QUERY_BYTES, MOST_IDENTIFIERS, MOST_K, MOST_LIMIT = 8192, 64, 50, 120


def check_request(query: str, identifiers: list[str] | None = None, k: int = 10, route_limit: int = ROUTE_LIMIT, depth: int = RERANK_DEPTH, pool: int = POOL) -> None:
    """Bounds of a search request; ValueError where one is broken."""
    if not query.strip() or len(query.encode()) > MOST_QUERY_BYTES:
        raise ValueError(f"a query has 1 to {MOST_QUERY_BYTES} bytes")
    if len(set(identifiers or ())) > MOST_IDENTIFIERS:
        raise ValueError(f"at most {MOST_IDENTIFIERS} identifiers")
    if not 1 <= k <= MOST_K or not 1 <= route_limit <= MOST_LIMIT or not 1 <= depth <= pool <= MOST_LIMIT:
        raise ValueError("k, limits or depth out of bounds")


def valid_vector(vector: Column, dimension: int) -> Column:
    """Exact dimension, all finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Products of vectors and queries that are held at once: 64 MB.
TILE_VALUES = 8 << 20


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 100_000) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of each query with every vector; ties by id.

    vectors (id, vector), queries (query_id, vector). Queries are broadcast, so over ``most_queries`` are
    asked in blocks by a hash of query_id, each block against all vectors, its result a table of its own.
    Norms are taken once a row, products per pair.
    """
    n = queries.count()
    if n > most_queries:
        # Blocks of half the bound, as a hash doesn't deal evenly.
        count = -(-2 * n // most_queries)
        block = F.pmod(F.xxhash64("query_id"), F.lit(count))
        queries = settle(queries.select("query_id", "vector"), "queries")
        parts = [settle(_dense_block(vectors, queries.where(block == i), k), "dense-block") for i in range(count)]
        return reduce(DataFrame.unionByName, parts)
    return _dense_block(vectors, queries, k)


def _dense_block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Products of each batch of vectors with all queries as one matrix product; a task keeps its batches' best ``k`` of each query, ties at the end too."""
    spark = vectors.sparkSession
    asked = [(r.query_id, r.q) for r in queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("q")).where("q IS NOT NULL").toLocalIterator()]
    kinds = {n: vectors.schema["id"].dataType.simpleString() if n == "id" else queries.schema["query_id"].dataType.simpleString() for n in ("query_id", "id")}
    shared, key_type = spark.sparkContext.broadcast(asked), to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        by_size = {}
        for key, q in shared.value:
            by_size.setdefault(len(q), []).append((key, np.array([np.nan if x is None else x for x in q], float)))
        groups = []
        for size, rows in by_size.items():
            matrix = np.stack([q for _, q in rows])
            norms = np.linalg.norm(matrix, axis=1)
            good = norms > 0
            groups.append((size, [key for (key, _), g in zip(rows, good, strict=True) if g], (matrix[good] / norms[good, None]).T))
        for batch in batches:
            # Lists as one flat buffer: a null list holds nothing, a null number is NaN.
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            flat = column.flatten().to_numpy(zero_copy_only=False)
            for size, keys, matrix in groups:
                at = np.flatnonzero(sizes == size)
                if not len(at) or not keys:
                    continue
                rows = flat[begins[at][:, None] + np.arange(size)].astype(float)
                norms = np.linalg.norm(rows, axis=1)
                at, rows, norms = at[norms > 0], rows[norms > 0], norms[norms > 0]
                if not len(at):
                    continue
                # As many queries at once as keep the products within a bound, whatever the batch.
                width = max(1, TILE_VALUES // len(at))
                for first in range(0, len(keys), width):
                    score = np.round(rows @ matrix[:, first : first + width] / norms[:, None], 6)
                    score[np.isnan(score)] = -np.inf
                    least = np.partition(score, max(len(at) - k, 0), axis=0)[max(len(at) - k, 0)]
                    row, col = np.nonzero((score >= least) & (score > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[first + c] for c in col.tolist()], key_type), batch.column(0).take(pa.array(at[row])), pa.array(score[row, col])], ["query_id", "id", "score"])

    best = map_arrow(vectors.select("id", F.transform("vector", lambda x: x.cast("double")).alias("v")), run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_route(vectors: DataFrame, queries: DataFrame, limit: int = ROUTE_LIMIT) -> DataFrame:
    """(query_id, chunk_id, rank): twice ``limit`` hits by exact cosine, ranked with ties by id, of which ``limit`` stay."""
    return tie_ranked(dense_topk(vectors, queries, 2 * limit).withColumnRenamed("id", "chunk_id"), limit)


def tie_ranked(hits: DataFrame, limit: int = ROUTE_LIMIT) -> DataFrame:
    """(query_id, chunk_id, rank): by score, but hits within TIE * max(1, |leader|) below a group's leader count as equal and go by id; first of each chunk; limit.

    Twice ``limit`` hits of a query take part, the best by score, then id. A group hangs on its leader, not on the hit
    before, so the group is a fold over the query's sorted hits, whose number that bounds.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    hits = hits.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= 2 * limit).drop("__r")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_id"))).alias("hits"))
    fold = f"""aggregate(hits, struct(cast(null as double) as leader, -1 as grp, cast(array() as array<struct<grp:int, chunk_id:string>>) as out),
        (s, x) -> if(s.leader is not null and s.leader + x.order <= {TIE!r}D * greatest(1D, abs(s.leader)),
            struct(s.leader as leader, s.grp as grp, concat(s.out, array(struct(s.grp as grp, cast(x.chunk_id as string) as chunk_id))) as out),
            struct(-x.order as leader, s.grp + 1 as grp, concat(s.out, array(struct(s.grp + 1 as grp, cast(x.chunk_id as string) as chunk_id))) as out)),
        s -> s.out)"""
    grouped = listed.select("query_id", F.explode(F.expr(fold)).alias("h")).groupBy("query_id", F.col("h.chunk_id").alias("chunk_id")).agg(F.min("h.grp").alias("grp"))
    order = Window.partitionBy("query_id").orderBy("grp", "chunk_id")
    return grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank")


def first_hits(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, route, chunk_id, rank): rank of each chunk's first occurrence by position, others' ranks closing up."""
    first = hits.groupBy("query_id", "route", "chunk_id").agg(F.min("position").alias("position"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "route").orderBy("position", "chunk_id"))).drop("position")
    return out if limit is None else out.where(F.col("rank") <= limit)


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, pool: int = POOL) -> DataFrame:
    """(query_id, chunk_id, score, position) by weighted reciprocal ranks; added up in route order so that sums are the same everywhere; ties by id."""
    weights = weights or {}
    shares = [F.coalesce(F.max(F.when(F.col("route") == r, F.lit(float(weights.get(r, 1.0))) / (k + F.col("rank")))), F.lit(0.0)) for r in ROUTES]
    total = shares[0]
    for share in shares[1:]:
        total = total + share
    fused = ranked.groupBy("query_id", "chunk_id").agg(total.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("position", F.row_number().over(order) - 1).where(F.col("position") < pool)


def rerank_order(fused: DataFrame, score: str = "rerank_score") -> DataFrame:
    """Scored first by score, ties and the unscored tail in fused order. Adds ``reranked``."""
    return fused.withColumn("reranked", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col(score).desc_nulls_last(), "position")) - 1)


def blend(ranked: DataFrame, weight: float, k: int = RRF_K, position: str = "reranked", fused: str = "position") -> DataFrame:
    """Mix of reranked and fused positions; ties keep fused order. Adds ``blended`` and ``blend_score``."""
    score = (1 - weight) / (k + F.col(position) + 1.0) + weight / (k + F.col(fused) + 1.0)
    out = ranked.withColumn("blend_score", score)
    return out.withColumn("blended", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("blend_score"), fused)) - 1)


def soft_demotion(ranked: DataFrame, multiplier: Column, position: str) -> DataFrame:
    """Order by multiplier / (position + 1); of equals the less penalised first. Adds ``demoted``."""
    out = ranked.withColumn("__m", F.coalesce(multiplier, F.lit(1.0)))
    order = Window.partitionBy("query_id").orderBy((F.col("__m") / (F.col(position) + 1)).desc(), F.desc("__m"), position)
    return out.withColumn("demoted", F.row_number().over(order) - 1).drop("__m")


def cap_demotion(ranked: DataFrame, cap: int, position: str, fused: str = "position", top: int = 10) -> DataFrame:
    """Each of the ``top`` fused items is moved up to its fused place plus ``cap``, one after the other. Adds ``capped``. A fold over one query's ranking, which a pool bounds."""
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "chunk_id", F.col(fused).alias("f")))).alias("r"))
    fold = f"""aggregate(sequence(0, {top - 1}), transform(r, x -> struct(x.chunk_id as chunk_id, x.f as f)), (s, f) ->
        if(not exists(s, x -> x.f = f), s, concat(
            slice(filter(s, x -> x.f <> f), 1, least(f + {cap}, cast(array_position(transform(s, x -> cast(x.f as bigint)), cast(f as bigint)) as int) - 1)),
            filter(s, x -> x.f = f),
            slice(filter(s, x -> x.f <> f), least(f + {cap}, cast(array_position(transform(s, x -> cast(x.f as bigint)), cast(f as bigint)) as int) - 1) + 1, size(s)))))"""
    return listed.select("query_id", F.posexplode(F.expr(fold)).alias("capped", "x")).select("query_id", F.col("x.chunk_id").alias("chunk_id"), "capped")


# Section classes by name, terms in a section's path, and terms of a question that asks for them.
SECTION_CLASSES = {
    "changelog": (("changelog", "change log"), ("changelog", "change log", "journal des modifications", "historique des modifications")),
    "release_notes": (("release notes", "release note"), ("release notes", "release note", "notes de version", "note de version")),
    "conversion": (("conversion",), ("conversion", "convert", "converting", "convertir")),
}
SOURCE_CLASSES = ("official_docs", "official_kb", "official_code", "community", "third_party", "internal_code")
DEMOTED_SOURCES = ("official_code", "community", "third_party", "internal_code")
SOURCE_WEIGHT = 0.6


def _has(text: str, phrases: tuple[str, ...]) -> Column:
    padded = F.concat(F.lit(" "), F.expr(prompt_form(text)), F.lit(" "))
    out = F.lit(False)
    for phrase in phrases:
        out = out | padded.contains(f" {phrase} ")
    return out


def section_prior(query: str, path: str, weight: float, classes: tuple[str, ...] = tuple(SECTION_CLASSES)) -> Column:
    """Multiplier of a passage by its section path; 1 where the question names one of the classes."""
    asked = _has(query, tuple(t for c in classes for t in SECTION_CLASSES[c][1]))
    held = _has(path, tuple(t for c in classes for t in SECTION_CLASSES[c][0]))
    return F.when(~asked & held, F.lit(1 - weight)).otherwise(F.lit(1.0))


def source_prior(source_class: str, weight: float = SOURCE_WEIGHT, demoted: tuple[str, ...] = DEMOTED_SOURCES) -> Column:
    return F.when(F.col(source_class).isin(*demoted), F.lit(1 - weight)).otherwise(F.lit(1.0))


def classify_sources(rows: DataFrame, rules: list[tuple[str | None, str | None, str | None, str]], kind: str, host: str, path: str) -> DataFrame:
    """First rule of (kind, host, path prefix, class) whose given parts match: kind equal, host equal but for case, path by prefix. Adds ``source_class``, null if none does."""
    out = F.lit(None).cast("string")
    for k, h, p, name in reversed(rules):
        test = F.lit(True)
        if k is not None:
            test = test & (F.col(kind) == k)
        if h is not None:
            test = test & (F.lower(host) == h.lower())
        if p is not None:
            test = test & F.col(path).startswith(p)
        out = F.when(test, F.lit(name)).otherwise(out)
    return rows.withColumn("source_class", out)


def identifier_route(postings: DataFrame, wanted: DataFrame, common: int | None = None, limit: int = IDENTIFIER_LIMIT) -> DataFrame:
    """(query_id, chunk_id, rank): chunks with any of the query's identifiers, by id. With ``common``, identifiers in over that many chunks are left out."""
    used = wanted
    if common is not None:
        counts = postings.join(wanted.select("identifier").distinct(), "identifier", "left_semi").groupBy("identifier").agg(F.countDistinct("chunk_id").alias("n"))
        used = wanted.join(counts.where(F.col("n") <= common), "identifier", "left_semi")
    found = postings.join(used, "identifier").select("query_id", "chunk_id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where(F.col("rank") <= limit)


def payload_filter(any_of: dict[str, list[str]] | None = None, exact: dict[str, str] | None = None) -> Column:
    """All of: array columns that share a value, and columns that equal one."""
    out = F.lit(True)
    for name, values in (any_of or {}).items():
        out = out & F.arrays_overlap(name, F.array(*map(F.lit, values)))
    for name, value in (exact or {}).items():
        out = out & (F.col(name) == value)
    return out
