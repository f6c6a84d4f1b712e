"""Registered queries of the engine's own operators over the driver's tables, with the same in DuckDB SQL.

Documents stand for revisions (set: source, version: lang), ``benchmark`` for questions, ``embeddings``
for dense vectors, ``events`` for the journal and ``pages`` for captured pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import identifiers as I
from stratum.functions import text as T
from stratum.operators import dedup, evaluation, evidence, inventory, lexical, quality, retrieval
from stratum.plans.registry import ORACLE_SQL, QUERIES, query
from stratum.runtime import settle, spread
from stratum.sources import corpus
from stratum.sources.tables import table
from stratum.streaming import journal

FLAGSHIP = "bm25_topk"
D = T.DUCK


# Lexical analysis and BM25.

_TERMS = """
{name}_tokens AS (SELECT {id} AS id, unnest({tokens}) AS t FROM {source}),
{name}_terms AS (SELECT id, {term} AS term FROM {name}_tokens),
{name}_tf AS (SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS length FROM {name}_terms WHERE term IS NOT NULL GROUP BY id, term)"""


def _terms(name: str, source: str, key: str) -> str:
    return _TERMS.format(name=name, id=key, source=source, tokens=T.tokens(T.fold("text", D), D), term=T.term("t", D))


_AVG = "av AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM d_tf) / (SELECT count(*) FROM documents) AS a)"
_WEIGHT = T.tf_weight("tf", "length", "a")


@query(
    f"""WITH {_terms('d', 'documents', 'doc_id')}, {_terms('q', 'benchmark', 'item_id')}, {_AVG},
s AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d_tf, av GROUP BY term),
r AS (SELECT query_id, d_tf.id AS id, round(sum(idf * {_WEIGHT}), 6) AS score FROM d_tf JOIN (SELECT id AS query_id, term AS q_term FROM q_tf) ON d_tf.term = q_term JOIN s ON d_tf.term = s.term, av GROUP BY query_id, d_tf.id)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r) WHERE rank <= 10"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


@query(f"WITH {_terms('d', 'documents', 'doc_id')}, {_AVG} SELECT term, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM d_tf, av GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tf = lexical.term_frequencies(docs, "doc_id", "text")
    return lexical.term_statistics(tf, lexical.average_length(tf, docs)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_terms('d', 'documents', 'doc_id')}, {_AVG} SELECT n AS passages, round(a, 6) AS average_length FROM av")
def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical.average_length(lexical.term_frequencies(docs, "doc_id", "text"), docs).withColumn("average_length", F.round("average_length", 6))


@query(f"WITH {_terms('d', 'benchmark', 'item_id')}, av AS (SELECT (SELECT sum(tf) FROM d_tf) / (SELECT count(*) FROM benchmark) AS a) SELECT id, {T.token_id('term', D)} AS token_id, round(CAST(sum({_WEIGHT}) AS DOUBLE), 4) AS weight FROM d_tf, av GROUP BY 1, 2")
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    tf = lexical.term_frequencies(items, "item_id", "text")
    return lexical.sparse_vectors(tf, lexical.average_length(tf, items)).withColumn("weight", F.round(F.col("weight").cast("double"), 4))


@query(f"SELECT doc_id, {T.normalize_whitespace('text', D)} AS normalized, {T.prompt_form('text', D)} AS prompt_form, {T.word_count('text', D)} AS words, {T.fold('text', D)} AS folded FROM documents")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = {"normalized": T.normalize_whitespace("text"), "prompt_form": T.prompt_form("text"), "words": f"cast({T.word_count('text')} as bigint)", "folded": T.fold("text")}
    return table(spark, sf_dir, "documents").select("doc_id", *(F.expr(v).alias(k) for k, v in forms.items()))


# Identifiers and questions.


@query(f"SELECT identifier, doc_id AS chunk_id FROM (SELECT doc_id, unnest({I.index_identifiers('text', D)}) AS identifier FROM documents)")
def identifier_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.explode(F.expr(I.index_identifiers("text"))).alias("identifier"), F.col("doc_id").alias("chunk_id"))


_POSTINGS = f"p AS (SELECT DISTINCT doc_id AS chunk_id, unnest({I.index_identifiers('text', D)}) AS identifier FROM documents)"


@query(f"WITH {_POSTINGS} SELECT identifier, count(DISTINCT chunk_id) AS chunks FROM p GROUP BY identifier HAVING count(DISTINCT chunk_id) > 1")
def too_common_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.too_common(_postings(spark, sf_dir), 1)


@query(
    f"""WITH {_POSTINGS}, w AS (SELECT DISTINCT chunk_id AS query_id, identifier FROM p WHERE chunk_id % 20 = 0),
c AS (SELECT identifier FROM p GROUP BY identifier HAVING count(DISTINCT chunk_id) <= 50)
SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT w.query_id, p.chunk_id FROM w JOIN c ON w.identifier = c.identifier JOIN p ON p.identifier = w.identifier)) WHERE rank <= 20"""
)
def identifier_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = _postings(spark, sf_dir)
    wanted = postings.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "identifier").distinct()
    return retrieval.identifier_route(postings, wanted, common=50)


@query(f"SELECT doc_id, {I.kind('text', D)} AS kind, {I.language('text', D)} AS language, {I.inventory_request('text', D)} AS inventory FROM documents")
def question_understanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(I.kind("text")).alias("kind"), F.expr(I.language("text")).alias("language"), F.expr(I.inventory_request("text")).alias("inventory"))


# Quality.


def _quality_sql() -> str:
    tests = quality.rule_tests("text", D)
    flags = ", ".join(f"CASE WHEN {test} THEN {{'s': {-quality.OUTCOMES.index(outcome)}, 'p': {k}, 'r': '{rule}', 'o': '{outcome}'}} END" for k, (rule, (outcome, test)) in enumerate(tests.items()))
    return f"SELECT doc_id, list_sort(list_filter([{flags}], lambda f: f IS NOT NULL)) AS f FROM documents"


@query(f"SELECT doc_id, CASE WHEN len(f) = 0 THEN 'accepted' ELSE f[1].o END AS outcome, array_to_string(list_transform(f, lambda x: x.r), ',') AS rules FROM ({_quality_sql()})")
def quality_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decide(quality.flags(spread(table(spark, sf_dir, "documents")))).select("doc_id", "outcome", F.array_join("rules", ",").alias("rules"))


@query(f"SELECT CASE WHEN len(f) = 0 THEN 'accepted' ELSE f[1].o END AS outcome, count(*) AS revisions FROM ({_quality_sql()}) GROUP BY 1")
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decide(quality.flags(spread(table(spark, sf_dir, "documents")))).groupBy("outcome").agg(F.count(F.lit(1)).alias("revisions"))


_BODY = "regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis')"


@query(
    f"""WITH b AS (SELECT page_id, {_BODY} AS body FROM pages), l AS (SELECT page_id, body, regexp_extract_all(body, '(?is)<a [^>]*>(.*?)</a>', 1) AS links FROM b),
c AS (SELECT page_id, len(links) AS links, {T.word_count("regexp_replace(body, '<[^>]*>', ' ', 'g')", D)} AS words, {T.word_count("regexp_replace(array_to_string(links, ' '), '<[^>]*>', ' ', 'g')", D)} AS link_words FROM l),
p AS (SELECT *, CASE WHEN words = 0 THEN 100 ELSE link_words * 100 // words END AS link_percent FROM c)
SELECT *, links >= 10 AND link_percent >= 90 AS navigation_heavy FROM p"""
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page_features(table(spark, sf_dir, "pages")).select("page_id", "links", "words", "link_words", "link_percent", "navigation_heavy")


@query(
    """SELECT doc_id, CASE WHEN source = 'src0' AND lang = 'fr' THEN 'r1' WHEN lang = 'de' THEN 'r2' WHEN source = 'src0' THEN 'r3' END AS rule_id FROM documents"""
)
def ledger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES (1, 'r1', 'src0', 'fr'), (2, 'r2', NULL, 'de'), (3, 'r3', 'src0', NULL) AS t(position, rule_id, source, lang)")
    return quality.ledger_first_match(table(spark, sf_dir, "documents"), rules, ["source", "lang"]).select("doc_id", "rule_id")


# Duplicates.


@query("SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS representative, count(*) AS members FROM documents GROUP BY 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS representative FROM documents")
def duplicate_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text")


_SHINGLES = r"""r AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text),
w AS (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM r),
s AS (SELECT DISTINCT id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY x.id, y.id),
j AS (SELECT a, b, shared, na.n + nb.n - shared AS united, round(shared / (na.n + nb.n - shared), 6) AS jaccard FROM p JOIN n na ON a = na.id JOIN n nb ON b = nb.id WHERE shared * 100 >= (na.n + nb.n - shared) * 85)"""


def _representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


def _near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.confirmed_pairs(docs, "doc_id", "text", kept=dedup.text_representatives(docs, "doc_id", "text"))


@query(f"WITH {_SHINGLES} SELECT * FROM j")
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_pairs(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT a AS x, b AS y, jaccard FROM j UNION ALL SELECT b, a, jaccard FROM j),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
roots AS (SELECT x AS member, least(min(y), x) AS root FROM reach GROUP BY x),
g AS (SELECT root, 'near-' || sha256('["' || string_agg(CAST(member AS VARCHAR), '","' ORDER BY CAST(member AS VARCHAR)) || '"]') AS group_id FROM roots GROUP BY root)
SELECT member, root, group_id, (SELECT max(jaccard) FROM e WHERE e.x = member) AS jaccard FROM roots JOIN g USING (root)"""
)
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_near_pairs(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT a AS x, b AS y, jaccard FROM j UNION ALL SELECT b, a, jaccard FROM j),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
roots AS (SELECT x AS member, least(min(y), x) AS root FROM reach GROUP BY x),
g AS (SELECT root, 'near-' || sha256('["' || string_agg(CAST(member AS VARCHAR), '","' ORDER BY CAST(member AS VARCHAR)) || '"]') AS group_id FROM roots GROUP BY root),
o AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative FROM documents)
SELECT id, representative, coalesce(group_id, '') AS group_id FROM o LEFT JOIN roots ON member = representative LEFT JOIN g USING (root)"""
)
def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grouped = dedup.groups(_near_pairs(spark, sf_dir))
    return dedup.membership(docs, grouped, "doc_id", "text").select("id", "representative", F.coalesce("group_id", F.lit("")).alias("group_id"))


@query()
def minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.candidate_pairs(dedup.minhash_signatures(_representatives(spark, sf_dir), "doc_id", "text"))


# Routes, fusion and policies.

_DENSE = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
dense AS (SELECT query_id, vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q),
dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense)"""


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return retrieval.dense_topk(vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), k)


@query(f"WITH {_DENSE} SELECT * FROM dr WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, 10)


_ROUTES = f"""{_DENSE}, lx AS (SELECT q.vec_id AS query_id, d.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(d.vec_id - q.vec_id), d.vec_id) AS rank
  FROM embeddings q JOIN embeddings d ON q.label = d.label WHERE q.vec_id % 20 = 0),
f AS (SELECT query_id, id AS chunk_id, coalesce(max(CASE WHEN r = 'd' THEN 1.0 / CAST(60 + rank AS DOUBLE) END), 0) + coalesce(max(CASE WHEN r = 'l' THEN 0.5 / CAST(60 + rank AS DOUBLE) END), 0) AS score
  FROM (SELECT 'd' AS r, query_id, id, rank FROM dr WHERE rank <= 50 UNION ALL SELECT 'l', query_id, id, rank FROM lx WHERE rank <= 50) GROUP BY query_id, id),
fused AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS position FROM f) WHERE position < 120)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    near = e.join(q, "label").select("query_id", F.col("vec_id").alias("id"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("id") - F.col("query_id")), "id"))).where("rank <= 50")
    lists = _dense(spark, sf_dir, 50).select("query_id", "id", "rank", F.lit("dense").alias("route")).unionByName(near.withColumn("route", F.lit("lexical")))
    return retrieval.fuse(lists.withColumnRenamed("id", "chunk_id"), {"lexical": 0.5}).withColumn("score", F.round("score", 12))


@query(f"WITH {_ROUTES} SELECT * FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir)


_RERANK = f"""{_ROUTES}, rr AS (SELECT *, CASE WHEN chunk_id % 7 <> 0 THEN chunk_id * 37 % 101 END AS s FROM fused),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, position) - 1 AS reranked FROM rr)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _fused(spark, sf_dir).withColumn("rerank_score", F.when(F.col("chunk_id") % 7 != 0, F.col("chunk_id") * 37 % 101))
    return retrieval.rerank_order(scored)


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 / CAST(61 + reranked AS DOUBLE) + 0.3 / CAST(61 + position AS DOUBLE) DESC, position) - 1 AS blended FROM o")
def rank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.blend(_reranked(spark, sf_dir), 0.3).select("query_id", "chunk_id", "blended")


@query(
    f"""WITH {_RERANK}, m AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN 1 - 0.6 ELSE 1.0 END AS m FROM o)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CAST(m AS DOUBLE) / CAST(reranked + 1 AS DOUBLE) DESC, m DESC, reranked) - 1 AS demoted FROM m"""
)
def soft_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _reranked(spark, sf_dir).withColumn("source_class", F.when(F.col("chunk_id") % 3 == 0, "community").otherwise("official_docs"))
    return retrieval.soft_demotion(held, retrieval.source_prior("source_class"), "reranked").select("query_id", "chunk_id", "demoted")


@query(
    f"""WITH RECURSIVE {_RERANK}, cap AS (SELECT query_id, -1 AS f, list(position ORDER BY reranked) AS l FROM o GROUP BY query_id
  UNION ALL SELECT query_id, f + 1, CASE WHEN list_contains(l, f + 1) THEN list_concat(list_concat(rest[1:t], [f + 1]), rest[t + 1:]) ELSE l END FROM (
    SELECT query_id, f, l, list_filter(l, lambda x: x <> f + 1) AS rest, least(f + 1 + 3, coalesce(list_position(l, f + 1), 1) - 1) AS t FROM cap WHERE f < 9))
SELECT x.query_id, o.chunk_id, x.capped FROM (SELECT query_id, unnest(l) AS position, generate_subscripts(l, 1) - 1 AS capped FROM cap WHERE f = 9) x JOIN o ON o.query_id = x.query_id AND o.position = x.position"""
)
def demotion_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.cap_demotion(_reranked(spark, sf_dir), 3, "reranked")


@query(
    f"""WITH RECURSIVE {_DENSE}, h AS (SELECT query_id, id, score, rank AS n FROM dr WHERE rank <= 200),
g AS (SELECT query_id, n, id, score AS leader, 0 AS grp FROM h WHERE n = 1
  UNION ALL SELECT h.query_id, h.n, h.id, CASE WHEN g.leader - h.score <= 1e-5 * greatest(1, abs(g.leader)) THEN g.leader ELSE h.score END, CASE WHEN g.leader - h.score <= 1e-5 * greatest(1, abs(g.leader)) THEN g.grp ELSE g.grp + 1 END
  FROM g JOIN h ON h.query_id = g.query_id AND h.n = g.n + 1)
SELECT * FROM (SELECT query_id, CAST(id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY grp, CAST(id AS VARCHAR)) AS rank FROM g) WHERE rank <= 100"""
)
def tie_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_route(vectors, vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"))


# Spans, packing, conflicts, versions.

_SPANS = "spans AS (SELECT l_orderkey AS revision_id, l_linenumber * 20 AS \"start\", CAST(l_linenumber * 20 + l_quantity AS BIGINT) AS \"end\" FROM lineitem)"
_UNION = """u AS (SELECT *, CASE WHEN "start" > max("end") OVER (PARTITION BY revision_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM spans),
i AS (SELECT *, sum(f) OVER (PARTITION BY revision_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM u),
united AS (SELECT revision_id, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM i GROUP BY revision_id, g)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("revision_id"), (F.col("l_linenumber") * 20).cast("long").alias("start"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("long").alias("end"))


@query(f"WITH {_SPANS}, {_UNION} SELECT * FROM united")
def span_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.span_union(_spans(spark, sf_dir))


@query(
    f"""WITH {_SPANS}, {_UNION}, x AS (SELECT o_orderkey AS revision_id, 30 AS a, 90 AS b FROM orders)
SELECT x.revision_id, 0 AS id, 60 AS wanted, coalesce(sum(least(b, "end") - greatest(a, "start")) FILTER (WHERE "start" IS NOT NULL AND greatest(a, "start") < least(b, "end")), 0) AS covered,
coalesce(sum(least(b, "end") - greatest(a, "start")) FILTER (WHERE "start" IS NOT NULL AND greatest(a, "start") < least(b, "end")), 0) * 1000 // 60 AS permille FROM x LEFT JOIN united USING (revision_id) GROUP BY x.revision_id"""
)
def span_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("revision_id"), F.lit(0).alias("id"), F.lit(30).cast("long").alias("start"), F.lit(90).cast("long").alias("end"))
    return evidence.coverage(expected, _spans(spark, sf_dir), "revision_id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.expr(T.word_count("line")).alias("words"))


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, pos, {T.word_count('line', D)} AS t FROM l),
s AS (SELECT doc_id, 0 AS pos, 0 AS chunk, t AS tokens FROM w WHERE pos = 0
  UNION ALL SELECT w.doc_id, w.pos, CASE WHEN s.tokens < 500 AND s.tokens + w.t <= 700 THEN s.chunk ELSE s.chunk + 1 END, CASE WHEN s.tokens < 500 AND s.tokens + w.t <= 700 THEN s.tokens + w.t ELSE w.t END FROM s JOIN w ON w.doc_id = s.doc_id AND w.pos = s.pos + 1),
d AS (SELECT doc_id, chunk, min(pos) AS a, max(pos) AS b, max(tokens) AS t FROM s GROUP BY doc_id, chunk),
k AS (SELECT doc_id, chunk AS at, 0 AS chunk, a, b, t FROM d WHERE chunk = 0
  UNION ALL SELECT d.doc_id, d.chunk, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.chunk ELSE k.chunk + 1 END, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.a ELSE d.a END, d.b, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.t + d.t ELSE d.t END
  FROM k JOIN d ON d.doc_id = k.doc_id AND d.chunk = k.at + 1)
SELECT doc_id, chunk, min(a) AS first, max(b) AS last, max(t) AS tokens FROM k GROUP BY doc_id, chunk"""
)
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.greedy_pack(_lines(spark, sf_dir), "doc_id", "pos", "words")


@query(
    """SELECT user_id, event_id, idea FROM (SELECT user_id, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS idea FROM
(SELECT user_id, event_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events))"""
)
def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.consecutive_groups(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "idea")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS occurrence FROM events")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.occurrence_numbers(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_id", "occurrence")


@query(
    """SELECT event_id, array_to_string(list_filter([CAST(lag(event_id, 1) OVER w AS VARCHAR), CAST(lead(event_id, 1) OVER w AS VARCHAR), CAST(lag(event_id, 2) OVER w AS VARCHAR), CAST(lead(event_id, 2) OVER w AS VARCHAR)], lambda x: x IS NOT NULL), ',') AS neighbours
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
)
def sibling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "events").withColumn("block_id", F.col("event_id").cast("string"))
    return evidence.sibling_window(blocks, "user_id", "event_id").select("event_id", F.array_join("neighbours", ",").alias("neighbours"))


_LEVELS = "h AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber * 10 AS \"start\", 1 + l_linenumber * 5 % 3 AS level FROM lineitem)"


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (1 + F.col("l_linenumber") * 5 % 3).alias("level"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("title")).distinct()


@query(f"WITH {_LEVELS} SELECT document_id, \"start\", coalesce((SELECT min(n.\"start\") FROM h n WHERE n.document_id = h.document_id AND n.\"start\" > h.\"start\" AND n.level <= h.level), 1000) AS extent_end FROM h")
def section_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _headings(spark, sf_dir)
    lengths = headings.select("document_id").distinct().withColumn("length", F.lit(1000).cast("long"))
    return evidence.section_extents(headings, lengths).select("document_id", "start", "extent_end")


@query(
    f"""WITH {_LEVELS}, a AS (SELECT h.document_id, h."start", p."start" AS s FROM h JOIN h p ON p.document_id = h.document_id AND p."start" <= h."start" AND (p."start" = h."start" OR (p.level < h.level AND NOT EXISTS (
SELECT 1 FROM h m WHERE m.document_id = h.document_id AND m."start" > p."start" AND m."start" < h."start" AND m.level <= p.level))))
SELECT document_id, "start", string_agg('t' || CAST(s // 10 AS VARCHAR), '/' ORDER BY s) AS heading_path FROM a GROUP BY document_id, "start\""""
)
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.heading_paths(_headings(spark, sf_dir)).select("document_id", "start", F.array_join("heading_path", "/").alias("heading_path"))


@query("SELECT p_brand, p_type, count(DISTINCT p_size) AS n_values, count(*) AS candidates FROM part GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1")
def table_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.conflicts(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_size")


_VERSIONS = "v AS (SELECT doc_id, text, CASE WHEN doc_id % 5 <> 0 THEN '1.' || CAST(doc_id % 97 AS VARCHAR) END AS version, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 97 END AS n FROM documents)"


@query(
    f"""WITH {_VERSIONS} SELECT doc_id, CASE WHEN count(*) OVER w = 1 THEN 'current' WHEN n IS NULL THEN 'undecided' WHEN n < max(n) OVER w THEN 'alternate' ELSE 'current' END AS status FROM v WINDOW w AS (PARTITION BY text)"""
)
def version_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").withColumn("version", F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("1."), (F.col("doc_id") % 97).cast("string"))))
    return evidence.version_collapse(held, ["text"], "version", "doc_id").select("doc_id", "status")


_POOL = f"""{_terms('d', 'documents', 'doc_id')}, {_terms('q', 'benchmark', 'item_id')}, {_AVG},
st AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d_tf, av GROUP BY term),
rs AS (SELECT query_id, d_tf.id AS id, round(sum(idf * {_WEIGHT}), 6) AS score FROM d_tf JOIN (SELECT id AS query_id, term AS q_term FROM q_tf) ON d_tf.term = q_term JOIN st ON d_tf.term = st.term, av GROUP BY query_id, d_tf.id),
c AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM rs) WHERE rank < 30),
w3 AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IN (SELECT id FROM c)),
g3 AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS s FROM w3),
ps AS (SELECT x.query_id, x.rank AS a, y.rank AS b, len(list_intersect(gx.s, gy.s)) AS n, len(gx.s) + len(gy.s) AS t FROM c x JOIN c y ON x.query_id = y.query_id AND x.rank <> y.rank JOIN g3 gx ON gx.id = x.id JOIN g3 gy ON gy.id = y.id),
sims AS (SELECT query_id, a, b, n / (t - n) AS s FROM ps WHERE n > 0)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pool = settle(lexical.bm25_topk(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 30), "pool")
    wanted = docs.join(pool.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = dedup.shingles(wanted, "doc_id", "text", 3).groupBy("id").agg(F.collect_set(F.xxhash64("shingle")).alias("shingles"))
    return pool.join(sets, "id", "left").select("query_id", F.col("id").cast("string").alias("chunk_id"), (F.col("rank") - 1).alias("rank"), F.lit(None).cast("string").alias("version"), F.coalesce("shingles", F.array().cast("array<long>")).alias("shingles"))


@query(
    f"""WITH RECURSIVE {_POOL},
sel AS (SELECT DISTINCT query_id, 0 AS step, CAST([] AS BIGINT[]) AS chosen FROM c
  UNION ALL SELECT query_id, step + 1, list_append(chosen, rank) FROM (
    SELECT query_id, step, chosen, rank, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 / (rank + 1) - 0.3 * m, 12) DESC, rank) AS r FROM (
      SELECT sel.query_id, sel.step, sel.chosen, c.rank, coalesce(max(sims.s), 0) AS m FROM sel JOIN c ON c.query_id = sel.query_id AND NOT list_contains(sel.chosen, c.rank)
      LEFT JOIN sims ON sims.query_id = sel.query_id AND sims.a = c.rank AND list_contains(sel.chosen, sims.b) WHERE sel.step < 10 GROUP BY ALL)) WHERE r = 1)
SELECT sel.query_id, CAST(c.id AS VARCHAR) AS chunk_id, sel.step - 1 AS selected FROM sel JOIN c ON c.query_id = sel.query_id AND c.rank = sel.chosen[sel.step] WHERE sel.step > 0"""
)
def mmr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.mmr_select(_pool(spark, sf_dir), 10)


# Scopes and inventories.

_REV = "rev AS (SELECT doc_id AS revision_id, doc_id % 400 AS document_id, source AS set_name, lang, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'valid' END AS status, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'quarantined' ELSE 'accepted' END AS disposition FROM documents)"


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("revision_id"), (i % 400).alias("document_id"), F.col("source").alias("set_name"), "lang", F.when(i % 11 == 0, "failed").otherwise("valid").alias("status"),
        F.when(i % 7 == 0, None).when(i % 5 == 0, "quarantined").otherwise("accepted").alias("disposition"),
    )


_LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY revision_id DESC) AS r FROM rev) WHERE r = 1)"


@query(f"WITH {_REV}, {_LAST} SELECT document_id, revision_id FROM last WHERE status <> 'failed' AND disposition IN ('accepted', 'accepted_with_warnings')")
def latest_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.latest_eligible(_revisions(spark, sf_dir), order="revision_id").select("document_id", "revision_id")


@query(f"WITH {_REV}, {_LAST} SELECT document_id, CASE WHEN status = 'failed' THEN 'failed' ELSE coalesce(disposition, 'undecided') END AS reason FROM last WHERE NOT coalesce(status <> 'failed' AND disposition IN ('accepted', 'accepted_with_warnings'), false)")
def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.left_out(_revisions(spark, sf_dir), order="revision_id").select("document_id", "reason")


@query(f"WITH {_REV} SELECT status, disposition, count(*) AS revisions FROM rev GROUP BY status, disposition")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.collection_counts(_revisions(spark, sf_dir))


@query(f"WITH {_REV} SELECT set_name AS value, count(DISTINCT document_id) AS documents, (SELECT count(DISTINCT document_id) FROM rev WHERE status <> 'failed' AND disposition = 'accepted') AS total FROM rev WHERE status <> 'failed' AND disposition = 'accepted' GROUP BY set_name")
def inventory_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_groups(_revisions(spark, sf_dir).where(inventory.eligible()), "set_name")


@query(f"WITH {_REV} SELECT document_id, revision_id, min(revision_id) AS chunk_id FROM rev GROUP BY document_id, revision_id ORDER BY document_id, revision_id LIMIT 20")
def inventory_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory_supports(_revisions(spark, sf_dir).withColumn("chunk_id", F.col("revision_id")))


@query(f"WITH {_REV} SELECT set_name || '/' || lang AS path, count(*) AS revisions FROM rev WHERE set_name IN ('src1', 'src12') OR set_name || '/' || lang IN ('src2/en', 'src0/de') GROUP BY 1")
def scope_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = spark.sql("SELECT * FROM VALUES ('src1'), ('src12'), ('src2/en'), ('src0/de'), ('src3/e') AS t(grant)")
    rows = _revisions(spark, sf_dir).withColumn("path", F.concat_ws("/", "set_name", "lang"))
    return inventory.visible(rows, grants).groupBy("path").agg(F.count(F.lit(1)).alias("revisions"))


@query("SELECT event_type, CASE WHEN json_type(props, '$.k') = 'VARCHAR' THEN 'text' ELSE 'missing' END AS found, count(*) AS events FROM events GROUP BY 1, 2")
def json_text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(inventory.text_metadata("props", "k").isNotNull(), "text").otherwise("missing")
    return table(spark, sf_dir, "events").select("event_type", found.alias("found")).groupBy("event_type", "found").agg(F.count(F.lit(1)).alias("events"))


# Evaluation.

_TRUTH = f"WITH {_DENSE}, expected AS (SELECT q.vec_id AS question_id, d.vec_id AS item, d.vec_id % 3 AS g FROM embeddings q JOIN embeddings d ON q.label = d.label AND d.vec_id <> q.vec_id AND d.vec_id < q.vec_id + 60 AND d.vec_id > q.vec_id - 60 WHERE q.vec_id % 20 = 0), un AS (SELECT question_id, CASE WHEN g = 0 THEN 'g:0' ELSE 'i:' || item END AS unit, min(rank) AS rank FROM expected LEFT JOIN (SELECT * FROM dr WHERE rank <= 50) x ON x.query_id = question_id AND x.id = item GROUP BY 1, 2)"
_CASES = " ".join(f"WHEN {r} THEN {d!r}" for r, d in enumerate(evaluation.DISCOUNTS, start=1))
_IDEAL = "list_sum(list_slice([" + ", ".join(repr(d) for d in evaluation.DISCOUNTS) + "], 1, least(count(*), 10)))"
_QUESTIONS = f"""{_TRUTH}, m AS (SELECT question_id, CASE WHEN min(rank) <= 5 THEN 1.0 ELSE 0 END AS r5, CASE WHEN min(rank) <= 10 THEN 1.0 ELSE 0 END AS r10, CASE WHEN min(rank) <= 10 THEN 1.0 / min(rank) ELSE 0 END AS mrr, sum(CASE rank {_CASES} ELSE 0 END) / {_IDEAL} AS ndcg FROM un GROUP BY question_id)"""


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "label")
    expected = q.join(e, "label").where("vec_id <> question_id AND vec_id < question_id + 60 AND vec_id > question_id - 60")
    expected = expected.select("question_id", F.col("vec_id").alias("item"), F.when(F.col("vec_id") % 3 == 0, "0").alias("group"))
    return evaluation.item_ranks(expected, _dense(spark, sf_dir, 50).select(F.col("query_id").alias("question_id"), F.col("id").alias("item"), "rank"))


@query(f"{_QUESTIONS} SELECT count(*) AS questions, round(avg(r5), 6) AS recall_5, round(avg(r10), 6) AS recall_10, round(avg(mrr), 6) AS mrr_10, round(avg(ndcg), 6) AS ndcg_10 FROM m")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_metrics(evaluation.question_metrics(_ranks(spark, sf_dir)))


# SplitMix64 in 128-bit integers: the state after d draws is seed + d * gamma.
_MIX = "CAST(CAST({x} AS UHUGEINT) * CAST('{m}' AS UHUGEINT) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"
_DRAWS = f"""z0 AS (SELECT r, pos, n, size, stratum, CAST((CAST('20260927' AS UHUGEINT) + CAST(r * total + pos + 1 AS UHUGEINT) * CAST('{0x9E3779B97F4A7C15}' AS UHUGEINT)) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT) AS z FROM slots, range(2000) AS t(r)),
z1 AS (SELECT * REPLACE ({_MIX.format(x='xor(z, z >> 30)', m=0xBF58476D1CE4E5B9)} AS z) FROM z0),
z2 AS (SELECT * REPLACE ({_MIX.format(x='xor(z, z >> 27)', m=0x94D049BB133111EB)} AS z) FROM z1),
draws AS (SELECT r, stratum, CAST((CAST(xor(z, z >> 31) AS UHUGEINT) * CAST(size AS UHUGEINT)) >> 64 AS BIGINT) AS at FROM z2)"""


def bootstrap_sql(values: str, columns: str = "v", statistic: str = "avg(v)", name: str = "mean") -> str:
    """Of rows (stratum, key, columns) of ``values``: the statistic and its interval."""
    return f"""slots AS (SELECT stratum, {columns}, row_number() OVER (ORDER BY stratum, key) - 1 AS pos, row_number() OVER (PARTITION BY stratum ORDER BY key) - 1 AS n, count(*) OVER (PARTITION BY stratum) AS size, count(*) OVER () AS total FROM {values}),
{_DRAWS}, means AS (SELECT r, {statistic} AS mean FROM draws JOIN slots ON slots.stratum = draws.stratum AND slots.n = draws.at GROUP BY r)
SELECT (SELECT round({statistic}, 9) FROM slots) AS {name}, round(quantile_disc(mean, 0.025), 9) AS low, round(quantile_disc(mean, 0.975), 9) AS high FROM means"""


def rounded(interval: DataFrame) -> DataFrame:
    return interval.select(*(F.round(c, 9).alias(c) for c in interval.columns))


@query(f"{_QUESTIONS}, vs AS (SELECT question_id % 2 AS stratum, question_id AS key, CAST(ndcg AS DOUBLE) AS v FROM m), {bootstrap_sql('vs')}")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = evaluation.question_metrics(_ranks(spark, sf_dir)).withColumn("stratum", F.col("question_id") % 2)
    return rounded(evaluation.bootstrap_interval(questions, "ndcg_10", "stratum", "question_id", 20260927))


@query("SELECT event_type AS cohort, count(*) AS attempts, count(*) FILTER (WHERE event_id % 10 = 0) AS warm_ups, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 6 <> 0) AS ok, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 6 = 0) AS failed, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, round(count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 6 <> 0) * 1e6 / sum(v), 6) AS per_second FROM (SELECT *, CASE WHEN event_id % 10 <> 0 AND event_id % 6 <> 0 THEN event_id * 7919 % 100003 + 1 END AS v FROM events) GROUP BY event_type")
def latency_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    attempts = table(spark, sf_dir, "events").select(F.col("event_type").alias("cohort"), (i % 10 == 0).alias("warm_up"), (i % 6 != 0).alias("ok"), (i * 7919 % 100003 + 1).alias("latency_us"))
    return evaluation.latency_cohorts(attempts)


@query(f"{_QUESTIONS}, o AS (SELECT 'top10' AS floor, r10 > 0 AS passed FROM m UNION ALL SELECT 'top1', mrr = 1 FROM m) SELECT floor, count(*) FILTER (WHERE passed) AS passed, count(*) AS of, CAST(ceil(count(*) * CASE floor WHEN 'top10' THEN 90 ELSE 70 END / 100) AS BIGINT) AS needed, count(*) FILTER (WHERE passed) >= ceil(count(*) * CASE floor WHEN 'top10' THEN 90 ELSE 70 END / 100) AS met FROM o GROUP BY floor")
def ladder_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.question_metrics(_ranks(spark, sf_dir))
    return evaluation.ladder(m.select(F.explode(F.array(F.struct(F.lit("top10").alias("floor"), (F.col("recall_10") > 0).alias("passed")), F.struct(F.lit("top1").alias("floor"), (F.col("mrr_10") == 1).alias("passed")))).alias("o")).select("o.*"))


# Journal.


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def journal_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "sequence")


@query("SELECT 'c' AS consumer, user_id, count(*) - CASE WHEN count(*) // 2 = 0 THEN 0 ELSE count(*) // 2 END AS lag FROM events GROUP BY user_id")
def cursor_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = journal.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    ends = journal.last_sequences(held, "user_id")
    cursors = ends.select(F.lit("c").alias("consumer"), "user_id", F.lit(0).cast("long").alias("position"))
    acks = ends.select(F.lit("c").alias("consumer"), "user_id", F.explode(F.array(F.floor(F.col("last") / 2), F.col("last") + 5)).alias("position")).where("position <= 1000000")
    acks = acks.join(ends, "user_id").where("position <= last").drop("last")
    return journal.cursor_lag(held, journal.acknowledge(cursors, acks, held, "user_id"), "user_id")


_STATES = "['running', 'succeeded', 'failed', 'queued', 'cancelled'][event_id % 5 + 1]"
_STEPS = ", ".join(f"'{a}>{b}'" for a, b in sorted(journal.JOB_STEPS))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, {_STATES} AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, 0 AS n, 'queued' AS state, 0 AS version, 0 AS refused FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT e.user_id, e.n, CASE WHEN f.state || '>' || e.s IN ({_STEPS}) THEN e.s ELSE f.state END, f.version + CASE WHEN f.state || '>' || e.s IN ({_STEPS}) THEN 1 ELSE 0 END, f.refused + CASE WHEN f.state || '>' || e.s IN ({_STEPS}) THEN 0 ELSE 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, arg_max(state, n) AS state, max(version) AS version, max(refused) AS refused FROM f GROUP BY user_id"""
)
def event_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(*map(F.lit, ("running", "succeeded", "failed", "queued", "cancelled"))), (F.col("event_id") % 5 + 1).cast("int"))
    return journal.fold_states(table(spark, sf_dir, "events").withColumn("state", states), "user_id", "event_id", "state", "queued", journal.JOB_STEPS)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value")


@query(
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.sessions(table(spark, sf_dir, "events"), "ts", "user_id")


# Revisions and artifacts.


@query("SELECT source, count(DISTINCT sha256(text)) AS digests FROM documents GROUP BY source HAVING count(DISTINCT sha256(text)) > 1")
def shared_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.shared_references(table(spark, sf_dir, "documents").withColumn("sha256", F.sha2("text", 256)), "source")


@query("SELECT sha256(text) AS digest, any_value(strlen(text)) AS bytes FROM documents GROUP BY 1 HAVING NOT bool_or(doc_id % 4 = 0)")
def artifact_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    pins = docs.select(F.sha2("content", 256).alias("digest"), F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0).alias("pins"))
    return corpus.collectable(corpus.put_artifacts(docs), pins).select("digest", "bytes")


@query("SELECT doc_id AS revision_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'unchanged' ELSE 'conflict' END AS change FROM documents")
def revision_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("revision_id"), F.sha2("text", 256).alias("content_hash"))
    held = incoming.where("revision_id % 3 <> 0").withColumn("content_hash", F.when(F.col("revision_id") % 3 == 1, F.col("content_hash")).otherwise("other"))
    return corpus.revision_changes(held, incoming).select("revision_id", "change")


# The other modules of queries register theirs as they are imported.
from stratum.plans import assembly_queries, document_queries, end_to_end, evaluation_queries, markdown_queries, search_queries, store_queries  # noqa: E402

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "assembly_queries", "document_queries", "evaluation_queries", "markdown_queries", "search_queries", "store_queries"]
