"""Registered queries of routes, policies and evidence assembly, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import assembly, evidence, inventory, retrieval
from stratum.plans import catalog
from stratum.plans.registry import query
from stratum.sources.tables import table

_POLICIES = f"""{catalog._RERANK}, m AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN 1 - 0.6 ELSE 1.0 END AS m FROM o),
bl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 / CAST(61 + reranked AS DOUBLE) + 0.3 / CAST(61 + position AS DOUBLE) DESC, position) - 1 AS blended FROM m),
dm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(m AS DOUBLE) / CAST(blended + 1 AS DOUBLE) DESC, m DESC, blended) - 1 AS demoted FROM bl),
cap AS (SELECT query_id, -1 AS f, list(position ORDER BY demoted) AS l FROM dm GROUP BY query_id
  UNION ALL SELECT query_id, f + 1, CASE WHEN list_contains(l, f + 1) THEN list_concat(list_concat(rest[1:t], [f + 1]), rest[t + 1:]) ELSE l END FROM (
    SELECT query_id, f, l, list_filter(l, lambda x: x <> f + 1) AS rest, least(f + 1 + 3, coalesce(list_position(l, f + 1), 1) - 1) AS t FROM cap WHERE f < 9))"""


@query(f"WITH RECURSIVE {_POLICIES} SELECT x.query_id, dm.chunk_id, x.place FROM (SELECT query_id, unnest(l) AS position, generate_subscripts(l, 1) - 1 AS place FROM cap WHERE f = 9) x JOIN dm ON dm.query_id = x.query_id AND dm.position = x.position")
def policy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = catalog._reranked(spark, sf_dir).withColumn("source_class", F.when(F.col("chunk_id") % 3 == 0, "community").otherwise("official_docs"))
    return assembly.apply_policies(held, 0.3, retrieval.source_prior("source_class"), 3)


@query(
    """SELECT doc_id AS query_id, coalesce(s < 0.5, true) AS triggered, CASE WHEN coalesce(s < 0.5, true) AND doc_id % 6 <> 0 AND (doc_id % 3 = 0 OR doc_id % 2 <> 0) AND (doc_id % 7 <> 0 OR doc_id % 11 = 0) THEN 'second' ELSE 'first' END AS kept
FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END AS s FROM documents)"""
)
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id")
    first = d.select(i.alias("query_id"), F.when(i % 4 != 0, (i % 10).cast("double") / 10).alias("top_score"), (i % 2 == 0).alias("reranked"), F.when(i % 11 == 0, 0).otherwise(3).alias("candidates"))
    second = d.where("doc_id % 6 <> 0").select(i.alias("query_id"), F.lit(0.0).alias("top_score"), (i % 3 == 0).alias("reranked"), F.when(i % 7 == 0, 0).otherwise(3).alias("candidates"))
    return assembly.second_pass(first, second, 0.5)


@query(r"WITH p AS (SELECT doc_id, regexp_extract_all(text, '^\s+|\S+\s*') AS p FROM documents), w AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(p) / 50) AS BIGINT))) AS n, p FROM p WHERE len(p) > 0) SELECT doc_id, max(length(array_to_string(list_slice(p, n * 50 + 1, n * 50 + 50), '')) % 97) AS score FROM w GROUP BY doc_id")
def rerank_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = assembly.rerank_windows(table(spark, sf_dir, "documents"), ["doc_id"], "text", 50)
    return assembly.window_max(windows.withColumn("score", F.length("text") % 97), ["doc_id"])


_FACTS = """fx AS (SELECT p_brand AS p, p_partkey AS c, p_size AS v, unnest([p_type, 'k:' || (p_partkey % 60)]) AS g FROM part),
sp AS (SELECT p, g FROM fx GROUP BY p, g HAVING count(DISTINCT v) > 1), dx AS (SELECT fx.* FROM fx JOIN sp ON sp.p = fx.p AND sp.g = fx.g),
ex AS (SELECT DISTINCT a.p, a.c AS x, b.c AS y FROM dx a JOIN dx b ON a.p = b.p AND a.g = b.g),
reach AS (SELECT p, x, y FROM ex UNION SELECT reach.p, reach.x, ex.y FROM reach JOIN ex ON reach.p = ex.p AND reach.y = ex.x),
un AS (SELECT p, x AS c, min(y) AS unit FROM reach GROUP BY p, x)"""


@query(f"WITH RECURSIVE {_FACTS} SELECT dx.p AS p_brand, unit, array_to_string(list_sort(list(DISTINCT dx.c)), ',') AS candidates, array_to_string(list_sort(list(DISTINCT dx.v)), ',') AS values FROM dx JOIN un ON un.p = dx.p AND un.c = dx.c GROUP BY dx.p, unit")
def conflict_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("candidate"), F.col("p_size").alias("value"), F.array("p_type", F.concat(F.lit("k:"), (F.col("p_partkey") % 60).cast("string"))).alias("families"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return assembly.conflict_findings(facts, ["p_brand"]).select("p_brand", "unit", listed("candidates"), listed("values"))


_CLASSES = """vc AS (SELECT 1 AS query_id, p_partkey AS chunk_id, p_partkey % 400 AS revision_id, 'p' || (p_partkey % 2) AS place, p_brand AS text, [p_type, 'k:' || (p_partkey % 60)] AS families, CASE WHEN p_partkey % 97 <> 0 THEN 'v' || (p_size % 4) || '.0' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END END AS version, (p_size % 4) * 10 + p_partkey % 3 AS k FROM part),
vx AS (SELECT chunk_id AS c, place || '|' || text || '|' || unnest(families) AS g FROM vc), ve AS (SELECT DISTINCT a.c AS x, b.c AS y FROM vx a JOIN vx b ON a.g = b.g),
vr AS (SELECT x, y FROM ve UNION SELECT vr.x, ve.y FROM vr JOIN ve ON vr.y = ve.x), cl AS (SELECT x AS chunk_id, min(y) AS class FROM vr GROUP BY x)"""


def _version_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    version = F.when(i % 97 != 0, F.concat(text("v", F.col("p_size") % 4, ".0", i % 3), F.when(i % 2 == 0, ".0").otherwise("")))
    return table(spark, sf_dir, "part").select(F.lit(1).alias("query_id"), i.alias("chunk_id"), (i % 400).alias("revision_id"), text("p", i % 2).alias("place"), F.col("p_brand").alias("text"), F.array("p_type", text("k:", F.col("p_partkey") % 60)).alias("families"), version.alias("version"))


@query(f"WITH RECURSIVE {_CLASSES} SELECT 1 AS query_id, chunk_id, class FROM cl")
def version_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.version_classes(_version_candidates(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_CLASSES}, j AS (SELECT vc.*, class FROM vc JOIN cl USING (chunk_id)),
s AS (SELECT *, CASE WHEN min(revision_id) OVER w = max(revision_id) OVER w THEN 'current' WHEN bool_or(version IS NULL) OVER w THEN 'undecided' WHEN k < max(k) OVER w THEN 'alternate' ELSE 'current' END AS status, k = max(k) OVER w AS is_top FROM j WINDOW w AS (PARTITION BY class))
SELECT query_id, chunk_id, class, status, CASE WHEN status = 'alternate' THEN min(chunk_id) FILTER (WHERE is_top) OVER (PARTITION BY class) ELSE -1 END AS winner FROM s"""
)
def collapsed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.collapsed_versions(_version_candidates(spark, sf_dir)).withColumn("winner", F.coalesce("winner", F.lit(-1)))


_GAPS = """q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN '1.' || (doc_id % 4) END AS version, doc_id % 5 = 0 AS inv, doc_id % 7 = 0 AS unres, doc_id % 11 = 0 AS latest, doc_id % 13 = 0 AS om, doc_id % 17 = 0 AS omc FROM documents),
pa AS (SELECT doc_id AS query_id, n, 'see E' || (doc_id % 3) || n || ' and v' || (doc_id % 2) AS text, '1.' || n AS version, (doc_id + n) % 4 = 0 AS win FROM documents, range(1, 4) AS t(n) WHERE doc_id % 10 <> 0),
ids AS (SELECT doc_id AS query_id, 'E' || k || '1' AS identifier FROM documents, range(2) AS t(k) WHERE doc_id % 2 = 0),
gp AS (SELECT query_id, CASE WHEN NOT EXISTS (SELECT 1 FROM pa WHERE pa.query_id = q.query_id) THEN [CASE WHEN inv THEN '{p}' ELSE '{e}' END] ELSE [] END || CASE WHEN unres THEN ['{u}'] ELSE [] END
 || coalesce((SELECT list('Required identifier "' || identifier || '"' || CASE WHEN query_id % 10 = 0 AND identifier = 'E11' THEN ' was found in candidates but is absent after budgeting.' ELSE ' is absent from returned passages.' END ORDER BY identifier) FROM ids WHERE ids.query_id = q.query_id AND NOT EXISTS (SELECT 1 FROM pa WHERE pa.query_id = q.query_id AND regexp_matches(pa.text, '(^|[^A-Za-z0-9])' || identifier || '([^A-Za-z0-9]|$)'))), [])
 || CASE WHEN version IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pa WHERE pa.query_id = q.query_id AND pa.version = q.version) THEN ['Requested version "' || version || '" is not represented in returned passages.'] ELSE [] END
 || CASE WHEN latest THEN ['{l}'] ELSE [] END || coalesce((SELECT list('Passage ' || n || ' is a window; surrounding section text is omitted.' ORDER BY n) FROM pa WHERE pa.query_id = q.query_id AND win), [])
 || CASE WHEN om THEN ['{o}'] ELSE [] END || CASE WHEN omc THEN ['{oc}'] ELSE [] END AS g FROM q)""".format(p=assembly.NO_PASSAGES, e=assembly.NO_EVIDENCE, u=assembly.UNRESOLVED, l=assembly.LATEST_UNKNOWN, o=assembly.OMITTED, oc=assembly.OMITTED_CONFLICT)


@query(f"WITH {_GAPS} SELECT query_id, unnest(g) AS gap, generate_subscripts(g, 1) - 1 AS position FROM gp")
def known_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    questions = d.select(i.alias("query_id"), F.when(i % 3 == 0, text("1.", i % 4)).alias("version"), (i % 5 == 0).alias("has_inventory"), (i % 7 == 0).alias("unresolved"), (i % 11 == 0).alias("latest_unknown"), (i % 13 == 0).alias("omitted"), (i % 17 == 0).alias("omitted_conflict"))
    n = F.col("n")
    passages = d.where("doc_id % 10 <> 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).select(i.alias("query_id"), "n", text("see E", i % 3, n, " and v", i % 2).alias("text"), text("1.", n).alias("version"), ((i + n) % 4 == 0).alias("windowed"))
    identifiers = d.where("doc_id % 2 = 0").select(i.alias("query_id"), F.explode(F.array(F.lit("E01"), F.lit("E11"))).alias("identifier"))
    candidates = d.where("doc_id % 10 = 0").select(i.alias("query_id"), F.lit("it was E11.").alias("text"))
    return assembly.known_gaps(questions, passages, identifiers, candidates)


@query(
    f"""WITH {catalog._SPANS}, s AS (SELECT l_orderkey AS revision_id, l_linenumber AS n, l_linenumber * 20 AS a, CAST(l_linenumber * 20 + l_quantity AS BIGINT) AS b, 'k' || l_linenumber AS chunk_id, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS score, CASE l_linenumber % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'lexical' ELSE 'identifier' END AS route FROM lineitem)
SELECT o_orderkey AS query_id, 1 AS n, max(score) AS score, array_to_string(list_sort(list(DISTINCT route)), ',') AS routes, array_to_string(list_sort(list(DISTINCT chunk_id)), ',') AS chunk_ids, bool_or(s.n = 2) AS procedural FROM orders JOIN s ON s.revision_id = o_orderkey AND a >= 20 AND b <= 100 GROUP BY o_orderkey"""
)
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("revision_id"), F.col("l_orderkey").alias("query_id"), (n * 20).cast("long").alias("start"), (n * 20 + F.col("l_quantity")).cast("long").alias("end"), F.concat(F.lit("k"), n.cast("string")).alias("chunk_id"),
        F.when(n % 2 == 0, F.col("l_quantity")).alias("score"), F.array(F.when(n % 3 == 0, "dense").when(n % 3 == 1, "lexical").otherwise("identifier")).alias("routes"), n.alias("line"),
    )
    k = F.col("o_orderkey")
    passages = table(spark, sf_dir, "orders").select(k.alias("query_id"), F.lit(1).alias("n"), k.alias("revision_id"), F.lit(20).cast("long").alias("start"), F.lit(100).cast("long").alias("end"))
    found = assembly.traces(passages, lines.drop("line"), lines.where("line = 2").select("revision_id", "start", "end"))
    return found.select("query_id", "n", "score", F.array_join("routes", ",").alias("routes"), F.array_join("chunk_ids", ",").alias("chunk_ids"), "procedural")


@query("WITH RECURSIVE w AS (SELECT p_partkey AS seed, p_partkey AS unit, 0 AS depth FROM part WHERE p_partkey % 100 = 7 UNION SELECT seed, unit // 3, depth + 1 FROM w WHERE unit // 3 > 0) SELECT seed, unit, min(depth) AS depth FROM w GROUP BY seed, unit")
def required_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    edges = parts.select(i.alias("unit"), F.floor(i / 3).alias("parent")).where("parent > 0")
    return assembly.required_context(parts.where("p_partkey % 100 = 7").select(i.alias("unit")), edges)


# Small operators on rows.


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id % 50 <> 0 AS valid FROM embeddings")
def valid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings").withColumn("v", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x: x * float("nan"))).otherwise(F.col("embedding")))
    return held.select("vec_id", retrieval.valid_vector(F.col("v"), 64).alias("valid"))


@query("SELECT doc_id, CASE WHEN lang = 'en' AND lower(source) = 'src1' THEN 'official_docs' WHEN lang = 'fr' THEN 'community' WHEN starts_with(source, 'src') AND lower(source) = 'src2' THEN 'official_kb' END AS source_class FROM documents")
def source_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("en", "SRC1", None, "official_docs"), ("fr", None, None, "community"), (None, "src2", "src", "official_kb")]
    return retrieval.classify_sources(table(spark, sf_dir, "documents"), rules, "lang", "source", "source").select("doc_id", "source_class")


@query("WITH f AS (SELECT user_id AS query_id, event_type AS route, event_id % 50 AS chunk_id, min(event_id) AS position FROM events GROUP BY 1, 2, 3) SELECT query_id, route, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY position, chunk_id) AS rank FROM f) WHERE rank <= 5")
def first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("route"), (F.col("event_id") % 50).alias("chunk_id"), F.col("event_id").alias("position"))
    return retrieval.first_hits(hits, 5)


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'how to convert a file' WHEN 1 THEN 'what changed' WHEN 2 THEN 'Show the Change-Log' ELSE 'preconversion' END AS q, CASE doc_id % 5 WHEN 0 THEN 'Guide / Change log' WHEN 1 THEN 'Conversion' WHEN 2 THEN 'release NOTES' ELSE 'intro' END AS p FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 2) THEN 1.0 WHEN doc_id % 5 IN (0, 1, 2) THEN 0.5 ELSE 1.0 END AS prior FROM t"""
)
def section_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    held = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 4 == 0, "how to convert a file").when(i % 4 == 1, "what changed").when(i % 4 == 2, "Show the Change-Log").otherwise("preconversion").alias("q"), F.when(i % 5 == 0, "Guide / Change log").when(i % 5 == 1, "Conversion").when(i % 5 == 2, "release NOTES").otherwise("intro").alias("p"))
    return held.select("doc_id", retrieval.section_prior("q", "p", 0.5).alias("prior"))


@query("SELECT l_orderkey AS query_id, l_linenumber AS position, row_number() OVER (PARTITION BY l_orderkey ORDER BY b, revision_id, l_linenumber * 10, l_linenumber * 10 + 5) AS n FROM (SELECT *, l_partkey % 3 AS revision_id, min(8 - l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey % 3) AS b FROM lineitem)")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    passages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), n.alias("line"), (8 - n).alias("position"), (F.col("l_partkey") % 3).alias("revision_id"), (n * 10).alias("start"), (n * 10 + 5).alias("end"))
    return evidence.reading_order(passages).select("query_id", F.col("line").alias("position"), "n")


@query(
    f"""WITH {catalog._LEVELS}, x AS (SELECT document_id, "start", coalesce((SELECT min(n."start") FROM h n WHERE n.document_id = h.document_id AND n."start" > h."start" AND n.level <= h.level), 1000) AS e FROM h),
s AS (SELECT o_orderkey AS document_id, o_orderkey * 10 + k AS span_id, 12 + k * 15 AS a, 12 + k * 15 + 6 AS b FROM orders, range(3) AS t(k))
SELECT span_id, coalesce(section_id, -1) AS section_id FROM (SELECT span_id, x."start" AS section_id, row_number() OVER (PARTITION BY span_id ORDER BY x."start" DESC, e) AS r FROM s LEFT JOIN x ON x.document_id = s.document_id AND x."start" <= a AND b <= e) WHERE r = 1"""
)
def deepest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = catalog._headings(spark, sf_dir)
    lengths = headings.select("document_id").distinct().withColumn("length", F.lit(1000).cast("long"))
    sections = evidence.section_extents(headings, lengths).select("document_id", F.col("start").alias("section_id"), F.col("start").alias("section_start"), F.col("extent_end").alias("section_end"))
    k = F.col("k")
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k")).select("document_id", (F.col("document_id") * 10 + k).alias("span_id"), (12 + k * 15).alias("start"), (12 + k * 15 + 6).alias("end"))
    return evidence.deepest_section(spans, sections).withColumn("section_id", F.coalesce("section_id", F.lit(-1)))


@query("SELECT doc_id, CASE WHEN try(decode(encode(text)[4:23])) IS NOT NULL THEN decode(encode(text)[4:23]) END AS slice FROM documents WHERE regexp_matches(text[1:40], '^[\\x00-\\x7F]*$')")
def byte_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.substring("text", 1, 40).rlike(r"^[\x00-\x7F]*$")).select("doc_id", F.expr(evidence.byte_slice("text", "3", "23")).alias("slice"))


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'see /etc/app.conf.' WHEN 1 THEN 'see /etc/app.config' WHEN 2 THEN '(/etc/app.conf)' WHEN 3 THEN 'x/etc/app.conf' WHEN 4 THEN '/etc/app.conf' ELSE 'see /etc/app.conf.bak' END AS t FROM documents) SELECT doc_id, doc_id % 6 IN (0, 2, 4) AS found FROM t"""
)
def literal_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    texts = F.when(i % 6 == 0, "see /etc/app.conf.").when(i % 6 == 1, "see /etc/app.config").when(i % 6 == 2, "(/etc/app.conf)").when(i % 6 == 3, "x/etc/app.conf").when(i % 6 == 4, "/etc/app.conf").otherwise("see /etc/app.conf.bak")
    return table(spark, sf_dir, "documents").select("doc_id", texts.alias("t"), F.lit("/etc/app.conf").alias("atom")).select("doc_id", inventory.has_literal("t", "atom").alias("found"))


@query("SELECT p.doc_id, g.g AS grant, p.path = g.g OR starts_with(p.path, g.g || '/') AS covers FROM (SELECT doc_id, source || '/' || lang AS path FROM documents) p, (VALUES ('src1'), ('src1/en'), ('src')) AS g(g)")
def scope_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), F.explode(F.array(F.lit("src1"), F.lit("src1/en"), F.lit("src"))).alias("grant"))
    return paths.select("doc_id", "grant", inventory.covers("grant", "path").alias("covers"))
