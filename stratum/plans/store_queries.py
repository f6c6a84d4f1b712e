"""Registered queries over the stored tables, whose rows are made of ``documents``, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import inventory, retrieval, store
from stratum.plans.registry import query
from stratum.sources import corpus
from stratum.sources.tables import table

_STORE = """docs AS (SELECT DISTINCT doc_id % 400 AS document_id, 'c' || (doc_id % 400 % 3) AS collection_id, 's' || (doc_id % 400 % 7) AS source_id FROM documents),
revs AS (SELECT doc_id AS revision_id, doc_id % 400 AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'valid' END AS status,
  CASE doc_id % 4 WHEN 0 THEN '{"version":"1.' || (doc_id % 5) || '","set":"' || source || '"}' WHEN 1 THEN '{"version":2,"set":"' || source || '"}' WHEN 2 THEN '{"set":null}' ELSE '{"version":"1.0"}' END AS metadata FROM documents),
disp AS (SELECT doc_id AS revision_id, CASE WHEN doc_id % 5 = 0 THEN 'quarantined' WHEN doc_id % 3 = 0 THEN 'accepted_with_warnings' ELSE 'accepted' END AS disposition FROM documents WHERE doc_id % 7 <> 0),
chunks AS (SELECT 'k' || doc_id || '-' || n AS chunk_id, 'set' || (doc_id % 2) AS chunk_set_id, doc_id AS revision_id FROM documents, range(3) AS t(n) WHERE n <= doc_id % 3 AND doc_id % 13 <> 0),
members AS (SELECT 'set' || (doc_id % 2) AS chunk_set_id, doc_id AS revision_id FROM documents),
gens AS (SELECT 'g' || i AS generation_id, 'set' || (i % 2) AS chunk_set_id, 'c' || (i % 3) AS collection_id FROM range(6) AS t(i)),
seen AS (SELECT * FROM docs WHERE collection_id = 'c0' OR collection_id || '/' || source_id IN ('c1/s3', 'c2/s5')),
own AS (SELECT revs.*, seen.collection_id, disp.disposition, CASE WHEN json_type(metadata, '$.version') = 'VARCHAR' THEN json_extract_string(metadata, '$.version') END AS version,
  CASE WHEN json_type(metadata, '$.set') = 'VARCHAR' THEN json_extract_string(metadata, '$.set') END AS set_name FROM revs JOIN seen USING (document_id) JOIN disp USING (revision_id) WHERE status <> 'failed' AND disposition IN ('accepted', 'accepted_with_warnings'))"""


def _store(spark: SparkSession, sf_dir: str) -> store.Store:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    document = i % 400
    metadata = (
        F.when(i % 4 == 0, text('{"version":"1.', i % 5, '","set":"', F.col("source"), '"}')).when(i % 4 == 1, text('{"version":2,"set":"', F.col("source"), '"}'))
        .when(i % 4 == 2, '{"set":null}').otherwise('{"version":"1.0"}')
    )
    set_id = text("set", i % 2)
    return store.Store(
        documents=d.select(document.alias("document_id")).distinct().select("document_id", text("c", F.col("document_id") % 3).alias("collection_id"), text("s", F.col("document_id") % 7).alias("source_id")),
        revisions=d.select(i.alias("revision_id"), document.alias("document_id"), F.when(i % 11 == 0, "failed").otherwise("valid").alias("status"), metadata.alias("metadata")),
        dispositions=d.where("doc_id % 7 <> 0").select(i.alias("revision_id"), F.when(i % 5 == 0, "quarantined").when(i % 3 == 0, "accepted_with_warnings").otherwise("accepted").alias("disposition")),
        chunks=d.where("doc_id % 13 <> 0").select(i.alias("revision_id"), set_id.alias("chunk_set_id"), F.explode(F.sequence(F.lit(0).cast("long"), i % 3)).alias("n")).select(text("k", F.col("revision_id"), "-", F.col("n")).alias("chunk_id"), "chunk_set_id", "revision_id"),
        members=d.select(set_id.alias("chunk_set_id"), i.alias("revision_id")),
        generations=spark.range(6).select(text("g", F.col("id")).alias("generation_id"), text("set", F.col("id") % 2).alias("chunk_set_id"), text("c", F.col("id") % 3).alias("collection_id")),
    )


def _grants(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('c0'), ('c1/s3'), ('c2/s5'), ('c2/s') AS t(grant)")


@query(f"WITH {_STORE} SELECT DISTINCT document_id, set_name AS group_value, own.revision_id FROM members JOIN own USING (revision_id) WHERE chunk_set_id = 'set0'")
def selected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.selected_members(_store(spark, sf_dir), "set0", "set", grants=_grants(spark))


_SELECTED = f"{_STORE}, sel AS (SELECT DISTINCT document_id, version AS value, own.revision_id FROM members JOIN own USING (revision_id) WHERE chunk_set_id = 'set1')"


@query(f"WITH {_SELECTED} SELECT value, count(DISTINCT document_id) AS documents, (SELECT count(DISTINCT document_id) FROM sel) AS total FROM sel GROUP BY value")
def member_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.member_inventory(_store(spark, sf_dir), "set1", "version", grants=_grants(spark))


@query(
    f"""WITH {_SELECTED}, g AS (SELECT value, count(DISTINCT document_id) AS documents, (SELECT count(DISTINCT document_id) FROM sel) AS total FROM sel GROUP BY value)
SELECT count(*) AS groups, CAST(sum(documents) AS BIGINT) AS documents, max(total) AS total, CAST(strlen('[' || string_agg('{{"value":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END || ',"documents":' || documents || '}}', ',') || ']') AS BIGINT) AS json_bytes,
sum(documents) = max(total) AND strlen('[' || string_agg('{{"value":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END || ',"documents":' || documents || '}}', ',') || ']') <= 32768 AS valid FROM g"""
)
def inventory_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.check_inventory(store.member_inventory(_store(spark, sf_dir), "set1", "version", grants=_grants(spark)))


@query(f"WITH {_SELECTED} SELECT document_id, sel.revision_id, min(chunk_id) AS chunk_id FROM sel JOIN chunks ON chunks.revision_id = sel.revision_id AND chunk_set_id = 'set1' GROUP BY document_id, sel.revision_id ORDER BY document_id, min(chunk_id) LIMIT 20")
def member_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.member_supports(_store(spark, sf_dir), "set1", "version", grants=_grants(spark))


@query(f"WITH {_STORE} SELECT DISTINCT chunk_id, own.revision_id, document_id FROM chunks JOIN own USING (revision_id) WHERE chunk_set_id = 'set0' AND own.revision_id % 3 = 1 AND version = '1.4'")
def requested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir)
    ids = held.chunks.where("revision_id % 3 = 1")
    return store.requested_chunks(held, ids.unionByName(ids).select("chunk_id"), "set0", grants=_grants(spark), version="1.4")


@query(f"WITH {_STORE} SELECT v AS version, EXISTS (SELECT 1 FROM chunks JOIN own USING (revision_id) JOIN gens USING (chunk_set_id) WHERE generation_id = 'g1' AND gens.collection_id = own.collection_id AND own.version = v) AS exists FROM (VALUES ('1.0'), ('9.9')) AS t(v)")
def version_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir)
    one = lambda v: store.version_exists(held, "g1", v, grants=_grants(spark)).select(F.lit(v).alias("version"), "exists")
    return one("1.0").unionByName(one("9.9"))


@query(f"WITH {_STORE} SELECT *, row_number() OVER (ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT chunk_id FROM chunks JOIN own USING (revision_id) WHERE chunk_set_id = 'set0' AND own.revision_id % 50 IN (4, 12) ORDER BY chunk_id LIMIT 20)")
def eligible_identifier_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir)
    postings = held.chunks.select("chunk_id", F.concat(F.lit("id"), (F.col("revision_id") % 50).cast("string")).alias("identifier"))
    wanted = spark.sql("SELECT * FROM VALUES ('id4'), ('id12'), ('none') AS t(identifier)")
    return store.identifier_chunks(held, postings, wanted, "set0", 20, grants=_grants(spark))


@query(f"WITH {_STORE} SELECT DISTINCT chunk_id, chunks.revision_id, document_id, docs.collection_id FROM gens JOIN chunks USING (chunk_set_id) JOIN revs USING (revision_id) JOIN docs USING (document_id) WHERE generation_id = 'g2' AND gens.collection_id = docs.collection_id")
def chunk_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.locations(_store(spark, sf_dir), "g2")


@query(f"WITH {_STORE} SELECT source_id, count(DISTINCT document_id) AS locations FROM docs GROUP BY source_id HAVING count(DISTINCT document_id) > 1")
def ambiguous_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.ambiguous(_store(spark, sf_dir).documents.select("source_id", "document_id"), "source_id")


_NEAR = "near AS (SELECT 'near-' || (doc_id // 3) AS group_id, doc_id AS revision_id, 0.9 AS jaccard FROM documents WHERE doc_id % 2 = 0)"


@query(f"WITH {_STORE}, {_NEAR} SELECT * FROM near WHERE group_id IN (SELECT group_id FROM near JOIN revs USING (revision_id) JOIN seen USING (document_id))")
def near_groups_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("near-"), F.floor(F.col("doc_id") / 3).cast("string")).alias("group_id"), F.col("doc_id").alias("revision_id"), F.lit(0.9).alias("jaccard"))
    return store.near_groups_seen(near, _store(spark, sf_dir), _grants(spark))


@query(f"WITH {_STORE} SELECT DISTINCT chunk_set_id FROM chunks c WHERE EXISTS (SELECT 1 FROM revs JOIN docs USING (document_id) WHERE revs.revision_id = c.revision_id AND collection_id = 'c1' AND source_id = 's3')")
def chunk_sets_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunk_sets_seen(_store(spark, sf_dir), spark.sql("SELECT 'c1/s3' AS grant"))


@query(f"WITH {_STORE} SELECT collection_id, status, disposition, count(*) AS revisions, count(DISTINCT document_id) AS documents FROM revs JOIN docs USING (document_id) LEFT JOIN disp USING (revision_id) GROUP BY ALL")
def disposition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.disposition_counts(_store(spark, sf_dir))


@query(
    """WITH s AS (SELECT source AS source_ref, lang || '/' || (doc_id % 9) AS path, row_number() OVER (PARTITION BY source, lang, doc_id % 9 ORDER BY doc_id) AS occurrence, doc_id AS section_id FROM documents)
SELECT q.doc_id AS question_id, q.path AS heading_path, q.occurrence, s.section_id, CASE WHEN s.section_id IS NULL THEN 0 ELSE 1 END AS matches FROM (SELECT doc_id, source, lang || '/' || (doc_id % 9) AS path, 1 + doc_id % 4 AS occurrence FROM documents WHERE doc_id % 20 = 0) q
LEFT JOIN s ON s.source_ref = q.source AND s.path = q.path AND s.occurrence = q.occurrence"""
)
def expected_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.array("lang", (F.col("doc_id") % 9).cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_ref"), path.alias("heading_path"))
    sections = d.withColumnRenamed("doc_id", "section_id").withColumn("occurrence", F.expr("row_number() over (partition by source_ref, heading_path order by section_id)"))
    asked = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("question_id"), "source_ref", "heading_path", (1 + F.col("doc_id") % 4).cast("int").alias("occurrence"))
    return store.expected_sections(asked, sections).select("question_id", F.array_join("heading_path", "/").alias("heading_path"), "occurrence", "section_id", "matches")


@query(
    f"""WITH {_STORE} SELECT 1 AS query_id, 'k' || doc_id || '-0' AS chunk_id, doc_id + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS revision_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'disagrees' ELSE 'loaded' END AS state FROM documents WHERE doc_id % 20 = 0 OR doc_id % 17 = 0"""
)
def candidate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    ranked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0 OR doc_id % 17 = 0").select(F.lit(1).alias("query_id"), F.concat(F.lit("k"), i.cast("string"), F.lit("-0")).alias("chunk_id"), F.when(i % 17 == 0, i + 1).otherwise(i).alias("revision_id"))
    return store.agreed_candidates(ranked, _store(spark, sf_dir).chunks).select("query_id", "chunk_id", "revision_id", "state")


@query(f"WITH {_STORE} SELECT DISTINCT chunk_id FROM chunks WHERE (revision_id % 6 IN (1, 5) OR revision_id % 7 = 2) AND chunk_set_id = 'set1' AND chunk_id > 'k3' ORDER BY chunk_id LIMIT 200")
def payload_scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("revision_id")
    points = _store(spark, sf_dir).chunks.withColumn("identifiers", F.array(F.concat(F.lit("a"), (i % 6).cast("string")), F.concat(F.lit("b"), (i % 7).cast("string"))))
    return store.payload_scroll(points, retrieval.payload_filter({"identifiers": ["a1", "a5", "b2"]}, {"chunk_set_id": "set1"}), 200, after="k3")


@query(
    f"""WITH {_STORE}, p AS (SELECT revision_id % 10 AS query_id, chunk_id, row_number() OVER (PARTITION BY revision_id % 10 ORDER BY chunk_id DESC) AS rank FROM chunks WHERE revision_id % 3 = 0),
k AS (SELECT revision_id % 10 AS query_id, chunk_id, row_number() OVER (PARTITION BY revision_id % 10 ORDER BY chunk_id) AS rank FROM chunks WHERE revision_id % 2 = 0),
b AS (SELECT *, 0 AS leg FROM p UNION ALL SELECT *, 1 FROM k), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY leg, rank) AS o FROM b)
SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY leg, f.rank) AS rank FROM f WHERE o = 1) WHERE rank <= 20"""
)
def identifier_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir).chunks.withColumn("query_id", F.col("revision_id") % 10)
    payload = held.where("revision_id % 3 = 0").withColumn("rank", F.expr("row_number() over (partition by query_id order by chunk_id desc)"))
    kernel = held.where("revision_id % 2 = 0").withColumn("rank", F.expr("row_number() over (partition by query_id order by chunk_id)"))
    return store.identifier_legs(payload, kernel, 20)


@query(f"WITH {_SELECTED}, s AS (SELECT min(chunk_id) AS chunk_id FROM sel JOIN chunks ON chunks.revision_id = sel.revision_id AND chunk_set_id = 'set1' GROUP BY document_id, sel.revision_id ORDER BY document_id, min(chunk_id) LIMIT 20) SELECT doc_id AS query_id, chunk_id, 1.0 AS score, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) AS rank FROM documents, s WHERE doc_id % 50 = 0")
def structured_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 50 == 0, "list_versions").alias("inventory"))
    return store.structured_route(asked, store.member_supports(_store(spark, sf_dir), "set1", "version", grants=_grants(spark)))


@query(f"WITH {_STORE} SELECT chunk_set_id, revision_id FROM members m WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE chunks.chunk_set_id = m.chunk_set_id AND chunks.revision_id = m.revision_id)")
def pending_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir)
    return store.pending_revisions(held.members, held.chunks)


@query(f"WITH {_STORE} SELECT 'collection' AS kind, collection_id AS path FROM (SELECT DISTINCT collection_id FROM docs) UNION ALL SELECT 'source', collection_id || '/' || source_id FROM (SELECT DISTINCT collection_id, source_id FROM docs) UNION ALL SELECT 'workspace', ''")
def known_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _store(spark, sf_dir).documents
    collections = d.select("collection_id").distinct().select(F.lit("collection").alias("kind"), F.col("collection_id").alias("path"))
    sources = d.select("collection_id", "source_id").distinct().select(F.lit("source").alias("kind"), F.concat_ws("/", "collection_id", "source_id").alias("path"))
    return corpus.union_scopes(spark.sql("SELECT 'workspace' AS kind, '' AS path"), collections, sources)


@query(f"WITH {_STORE} SELECT 'k' || doc_id || '-0' AS chunk_id FROM documents WHERE doc_id % 13 = 0")
def unverified_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string"), F.lit("-0")).alias("chunk_id"))
    return corpus.verify_generation(_store(spark, sf_dir).chunks.select(F.col("chunk_id").alias("point_id")), chunks)


@query(f"WITH {_STORE}, inc AS (SELECT revision_id, 'excluded' AS disposition FROM disp WHERE revision_id % 10 = 1 UNION ALL SELECT doc_id, 'accepted' FROM documents WHERE doc_id % 7 = 0) SELECT revision_id, coalesce(inc.disposition, disp.disposition) AS disposition FROM disp FULL JOIN inc USING (revision_id)")
def upserted_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark, sf_dir).dispositions
    fresh = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("revision_id"), F.lit("accepted").alias("disposition"))
    return corpus.upsert(held, held.where("revision_id % 10 = 1").withColumn("disposition", F.lit("excluded")).unionByName(fresh), ["revision_id"])
