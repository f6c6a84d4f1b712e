"""Registered queries of blocks, chunks, record quality, journal and identities, with DuckDB SQL. A document's lines stand for its blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import identifiers as I
from stratum.functions import text as T
from stratum.operators import blocks, inventory, quality
from stratum.plans.registry import query
from stratum.sources.tables import table
from stratum.streaming import journal

D = T.DUCK
_LINES = """l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
lb AS (SELECT document_id, position, CASE WHEN position % 7 = 0 THEN 'heading' WHEN position % 5 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind, CASE WHEN position % 7 = 0 THEN 1 + position % 3 ELSE 0 END AS level, text,
  CAST(sum(strlen(text) + 1) OVER (PARTITION BY document_id ORDER BY position) AS BIGINT) - strlen(text) - 1 AS a, CAST(sum(strlen(text) + 1) OVER (PARTITION BY document_id ORDER BY position) AS BIGINT) - 1 AS b FROM l)"""


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    p = F.col("position")
    upto = F.expr("sum(octet_length(text) + 1) over (partition by document_id order by position)")
    kind = F.when(p % 7 == 0, "heading").when(p % 5 == 0, "list_item").otherwise("paragraph")
    placed = lines.withColumns({"kind": kind, "level": F.when(p % 7 == 0, 1 + p % 3).otherwise(0), "end": upto - 1})
    return placed.withColumn("start", F.col("end") - F.octet_length("text"))


@query(f"WITH {_LINES} SELECT doc_id AS document_id, CAST(strlen(text) AS BIGINT) AS bytes, coalesce(n, 0) AS in_blocks, CAST(strlen(text) - coalesce(n, 0) AS BIGINT) AS between, true AS valid FROM documents LEFT JOIN (SELECT document_id, CAST(sum(b - a) AS BIGINT) AS n FROM lb WHERE regexp_matches(text, '\\S') GROUP BY 1) ON document_id = doc_id")
def byte_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.byte_accounting(_line_blocks(spark, sf_dir).where(r"text rlike '\\S'"), table(spark, sf_dir, "documents"), "doc_id")


_PLAIN = "regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')"


@query(f"""WITH {_LINES} SELECT document_id, sha256('[' || string_agg('{{"kind":"' || kind || '","level":' || level || ',"text":"' || {_PLAIN} || '"}}', ',' ORDER BY position) || ']') AS digest FROM lb GROUP BY document_id""")
def comparison_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.comparison_digest(_line_blocks(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9 ]", "")))


@query(
    f"""WITH {_LINES}, dg AS (SELECT document_id, sha256(string_agg(kind || level || {_PLAIN}, '|' ORDER BY position)) AS g FROM lb GROUP BY document_id)
SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY sha256(text), g) AS representative FROM documents JOIN dg ON document_id = doc_id"""
)
def canonical_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = blocks.comparison_digest(_line_blocks(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^A-Za-z0-9 ]", "")))
    return blocks.exact_duplicates(table(spark, sf_dir, "documents"), digests, "doc_id")


_CHROME = f"""{_LINES}, ch AS (SELECT document_id, position, CASE position % 7 WHEN 0 THEN 'heading' WHEN 3 THEN 'html' ELSE 'paragraph' END AS kind,
  CASE position % 7 WHEN 0 THEN text || '{blocks.HEADING_SUFFIX}' WHEN 1 THEN text || '{blocks.PARAGRAPH_SUFFIX}' WHEN 2 THEN '{blocks.LABEL_BEFORE_IMAGE}' WHEN 3 THEN '{blocks.IMAGE}' WHEN 4 THEN '{blocks.LABEL}' WHEN 5 THEN '<a name="x"></a><br/>' ELSE text END AS text, text AS was FROM lb),
ru AS (SELECT *, CASE position % 7 WHEN 0 THEN 'heading_suffix' WHEN 1 THEN 'paragraph_suffix' WHEN 2 THEN CASE WHEN lead(position) OVER (PARTITION BY document_id ORDER BY position) IS NOT NULL THEN 'label_before_image' END WHEN 3 THEN 'markup' WHEN 4 THEN 'label' WHEN 5 THEN 'markup' END AS rule FROM ch),
kp AS (SELECT *, CASE WHEN rule IS NULL THEN text WHEN rule LIKE '%suffix' THEN nullif(rtrim(was, ' '), '') END AS kept FROM ru)"""


def _chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("position") % 7, F.col("text")
    text = F.when(p == 0, F.concat(t, F.lit(blocks.HEADING_SUFFIX))).when(p == 1, F.concat(t, F.lit(blocks.PARAGRAPH_SUFFIX))).when(p == 2, blocks.LABEL_BEFORE_IMAGE).when(p == 3, blocks.IMAGE).when(p == 4, blocks.LABEL).when(p == 5, '<a name="x"></a><br/>').otherwise(t)
    return blocks.indexed_blocks(_line_blocks(spark, sf_dir).withColumns({"kind": F.when(p == 0, "heading").when(p == 3, "html").otherwise("paragraph"), "text": text}))


@query(f"WITH {_CHROME} SELECT document_id, position, coalesce(rule, '') AS rule, coalesce(kept, '') AS kept FROM kp")
def indexed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chrome(spark, sf_dir).select("document_id", "position", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("kept", F.lit("")).alias("kept"))


@query(f"WITH {_CHROME} SELECT rule, count(*) AS units, CAST(sum(strlen(text) - coalesce(strlen(kept), 0)) AS BIGINT) AS bytes FROM kp WHERE rule IS NOT NULL GROUP BY rule")
def chrome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chrome_counts(_chrome(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_LINES}, sc AS (SELECT *, count(*) FILTER (WHERE kind = 'heading') OVER (PARTITION BY document_id ORDER BY position) AS section FROM lb),
pw AS (SELECT document_id, section, position, regexp_extract_all(text, '^\\s+|\\S+\\s*') AS p FROM sc WHERE kind <> 'heading'),
un AS (SELECT document_id, section, position, w, len(list_filter(list_slice(p, w * 700 + 1, w * 700 + 700), lambda x: regexp_matches(x, '\\S'))) AS t FROM (SELECT *, unnest(range(0, CAST(ceil(len(p) / 700) AS BIGINT))) AS w FROM pw WHERE len(p) > 0)),
u AS (SELECT document_id, section, position, t, row_number() OVER (PARTITION BY document_id, section ORDER BY position, w) - 1 AS i FROM un),
s AS (SELECT document_id, section, position, i, 0 AS chunk, t AS tokens FROM u WHERE i = 0
  UNION ALL SELECT u.document_id, u.section, u.position, u.i, CASE WHEN s.tokens < 500 AND s.tokens + u.t <= 700 THEN s.chunk ELSE s.chunk + 1 END, CASE WHEN s.tokens < 500 AND s.tokens + u.t <= 700 THEN s.tokens + u.t ELSE u.t END FROM s JOIN u ON u.document_id = s.document_id AND u.section = s.section AND u.i = s.i + 1),
d AS (SELECT document_id, section, chunk, min(position) AS a, max(position) AS b, max(tokens) AS t FROM s GROUP BY 1, 2, 3),
k AS (SELECT document_id, section, chunk AS at, 0 AS chunk, a, b, t FROM d WHERE chunk = 0
  UNION ALL SELECT d.document_id, d.section, d.chunk, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.chunk ELSE k.chunk + 1 END, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.a ELSE d.a END, d.b, CASE WHEN d.t < 150 AND k.t + d.t <= 700 THEN k.t + d.t ELSE d.t END
  FROM k JOIN d ON d.document_id = k.document_id AND d.section = k.section AND d.chunk = k.at + 1),
h AS (SELECT document_id, section, position, level, text FROM sc WHERE kind = 'heading'),
cx AS (SELECT h.document_id, h.section, string_agg(p.text, ' > ' ORDER BY p.position) AS context FROM h JOIN h p ON p.document_id = h.document_id AND p.position <= h.position AND (p.position = h.position OR (p.level < h.level AND NOT EXISTS (
  SELECT 1 FROM h m WHERE m.document_id = h.document_id AND m.position > p.position AND m.position < h.position AND m.level <= p.level))) GROUP BY 1, 2)
SELECT k.document_id, k.section, chunk, min(a) AS first, max(b) AS last, max(t) AS tokens, coalesce(any_value(context), '') AS context FROM k LEFT JOIN cx ON cx.document_id = k.document_id AND cx.section = k.section GROUP BY k.document_id, k.section, chunk"""
)
def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chunk_documents(_line_blocks(spark, sf_dir))


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = blocks.blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return parsed.groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


_TABLES = """tb AS (SELECT doc_id // 4 AS document_id, doc_id AS position, CASE WHEN doc_id % 4 = 3 THEN 'paragraph' ELSE 'table_row' END AS kind, '| a | b |' || CASE WHEN doc_id % 6 = 0 THEN ' c |' ELSE '' END AS text FROM documents)"""


@query(f"WITH {_TABLES}, n AS (SELECT document_id, position, CASE WHEN text LIKE '%c |' THEN 3 ELSE 2 END AS cells FROM tb WHERE kind = 'table_row') SELECT document_id, count(*) AS rows FROM n GROUP BY document_id HAVING min(cells) <> max(cells)")
def incomplete_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    parsed = table(spark, sf_dir, "documents").select(F.floor(i / 4).alias("document_id"), i.alias("position"), F.when(i % 4 == 3, "paragraph").otherwise("table_row").alias("kind"), F.concat(F.lit("| a | b |"), F.when(i % 6 == 0, " c |").otherwise("")).alias("text"))
    return blocks.incomplete_tables(parsed).select("document_id", "rows")


_ESCAPED = r"""CASE doc_id % 5 WHEN 0 THEN 'a \\_b\\_ &lt;i&gt;' WHEN 1 THEN 'x\\\\\\\\\\*y' WHEN 2 THEN '\\u003cb\\u003e &amp;lt; &#39;q&#39; &quot;' WHEN 3 THEN 'plain \\n' ELSE text END"""


@query(f"SELECT doc_id, {T.unescape('t', D)} AS plain FROM (SELECT doc_id, {_ESCAPED.replace(chr(92) * 2, chr(92))} AS t FROM documents)")
def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_ESCAPED).alias("t")).select("doc_id", F.expr(T.unescape("t")).alias("plain"))


@query(f"SELECT doc_id, coalesce(({I.found('text', 'version', D)})[1], '') AS version FROM documents")
def version_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.expr(f"get({I.found('text', 'version')}, 0)"), F.lit("")).alias("version"))


# Quality of records.

_RECORDS = """rc AS (SELECT doc_id, doc_id % 11 = 0 AS failed, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'r' END AS source_ref, CASE WHEN doc_id % 17 <> 0 THEN 't' END AS title, doc_id % 3 AS tables, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS assets,
  CASE WHEN doc_id % 19 = 0 THEN 'accepted' WHEN doc_id % 23 = 0 THEN 'excluded' END AS kept, CASE WHEN doc_id % 4 = 0 THEN 'accepted' WHEN doc_id % 29 = 0 THEN 'quarantined' END AS ledger FROM documents),
fl AS (SELECT *, list_filter([CASE WHEN failed THEN 'canonicalization.failed' END, CASE WHEN tables > 0 THEN 'table.incomplete' END, CASE WHEN trim(source_ref) = '' OR title IS NULL THEN 'metadata.missing' END, CASE WHEN assets > 0 THEN 'assets.missing' END], lambda x: x IS NOT NULL) AS f FROM rc),
od AS (SELECT *, list_transform(list_sort(list_transform(f, lambda x: {'s': CASE x WHEN 'metadata.missing' THEN -3 WHEN 'canonicalization.failed' THEN -2 ELSE -1 END, 'p': CASE x WHEN 'canonicalization.failed' THEN -10 WHEN 'table.incomplete' THEN 45 WHEN 'metadata.missing' THEN 100 ELSE 110 END, 'r': x})), lambda x: x.r) AS rules FROM fl),
dc AS (SELECT *, CASE WHEN kept IS NOT NULL THEN 'kept' WHEN ledger IS NOT NULL AND NOT (failed AND ledger = 'accepted') THEN 'ledger' ELSE 'rule' END AS decided_by,
  CASE WHEN kept IS NOT NULL THEN kept WHEN ledger IS NOT NULL AND NOT (failed AND ledger = 'accepted') THEN ledger WHEN len(rules) = 0 THEN 'accepted' ELSE CASE rules[1] WHEN 'metadata.missing' THEN 'quarantined' WHEN 'canonicalization.failed' THEN 'needs_reextraction' ELSE 'accepted_with_warnings' END END AS outcome FROM od)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("a plain text of quite enough words to be one that nothing flags").alias("text"), (i % 11 == 0).alias("failed"), F.when(i % 13 == 0, " ").otherwise("r").alias("source_ref"), F.when(i % 17 != 0, "t").alias("title"), (i % 3).alias("tables"),
        F.when(i % 5 == 0, 2).otherwise(0).alias("assets"), F.when(i % 19 == 0, "accepted").when(i % 23 == 0, "excluded").alias("kept"), F.when(i % 4 == 0, "accepted").when(i % 29 == 0, "quarantined").alias("ledger"),
    )
    extra = quality.record_flags(F.col("failed"), F.col("source_ref"), F.col("title"), F.col("tables"), F.col("assets"))
    return quality.decide(quality.flags(rows, extra=extra), "kept", "ledger", "failed")


@query(f"WITH {_RECORDS} SELECT doc_id, outcome, decided_by, array_to_string(rules, ',') AS rules FROM dc")
def record_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("doc_id", "outcome", "decided_by", F.array_join("rules", ",").alias("rules"))


@query(
    f"""WITH {_RECORDS} SELECT 'outcome' AS kind, outcome AS name, count(*) AS revisions FROM dc GROUP BY outcome UNION ALL SELECT 'rule', r, count(*) FROM (SELECT unnest(rules) AS r FROM dc) GROUP BY r
UNION ALL SELECT 'decided_by', decided_by, count(*) FROM dc GROUP BY decided_by UNION ALL SELECT 'outranked', ledger, count(*) FROM dc WHERE decided_by = 'kept' AND ledger IS NOT NULL AND ledger <> outcome GROUP BY ledger"""
)
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate_report(_decided(spark, sf_dir), "ledger")


# Journal, leases and generations.


@query("SELECT event_id, user_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events) WHERE user_id % 2 = 0 AND sequence > user_id % 5 AND event_type = 'click'")
def events_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = journal.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])
    cursors = held.select("user_id").distinct().where("user_id % 2 = 0").select("user_id", F.lit("c").alias("consumer"), (F.col("user_id") % 5).alias("position"))
    return journal.read_after(held, cursors, "user_id", "click", "event_type").select("event_id", "user_id", "sequence")


@query("""SELECT user_id || '/' || sequence AS id, '{"specversion":"1.0","id":"' || user_id || '/' || sequence || '","source":"' || user_id || '","type":"' || event_type || '","sequence":' || sequence || ',"data":' || event_id || '}' AS envelope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events)""")
def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.envelopes(journal.sequenced(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]), "user_id", "event_type", "event_id")


_REQUESTS = "rq AS (SELECT user_id AS job_id, event_id AS at, ['take', 'heartbeat', 'take', 'succeed', 'fail'][event_id % 5 + 1] AS op, 'h' || (event_id % 3) AS holder, 1 + event_id % 4 AS number, 40 + event_id % 300 AS term, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


@query(
    f"""WITH RECURSIVE {_REQUESTS},
f AS (SELECT job_id, 0 AS n, 'queued' AS state, 0 AS number, CAST(NULL AS VARCHAR) AS holder, 0 AS expires, 0 AS takeovers, 0 AS refused FROM (SELECT DISTINCT job_id FROM rq)
  UNION ALL SELECT f.job_id, x.n, CASE c WHEN 'grant' THEN 'running' WHEN 'over' THEN 'running' WHEN 'end' THEN CASE op WHEN 'succeed' THEN 'succeeded' ELSE 'failed' END ELSE f.state END, CASE WHEN c IN ('grant', 'over') THEN f.number + 1 ELSE f.number END,
    CASE WHEN c IN ('grant', 'over') THEN x.holder WHEN c = 'end' THEN NULL ELSE f.holder END, CASE WHEN c IN ('grant', 'over', 'beat') THEN x.at + x.term WHEN c = 'end' THEN 0 ELSE f.expires END, f.takeovers + CASE WHEN c = 'over' THEN 1 ELSE 0 END, f.refused + CASE WHEN c = 'no' THEN 1 ELSE 0 END
  FROM (SELECT f.*, x.n AS xn, CASE WHEN x.op = 'take' AND f.state = 'queued' THEN 'grant' WHEN x.op = 'take' AND f.state = 'running' AND f.expires <= x.at THEN 'over' WHEN f.state = 'running' AND f.holder = x.holder AND f.number = x.number AND x.op = 'heartbeat' THEN 'beat'
    WHEN f.state = 'running' AND f.holder = x.holder AND f.number = x.number AND x.op IN ('succeed', 'fail') THEN 'end' ELSE 'no' END AS c FROM f JOIN rq x ON x.job_id = f.job_id AND x.n = f.n + 1) f JOIN rq x ON x.job_id = f.job_id AND x.n = f.xn)
SELECT job_id, state, number, coalesce(holder, '') AS holder, expires, takeovers, refused FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY n DESC) AS r FROM f) WHERE r = 1"""
)
def job_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ops = F.element_at(F.array(*map(F.lit, ("take", "heartbeat", "take", "succeed", "fail"))), (i % 5 + 1).cast("int"))
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), i.alias("at"), i.alias("seq"), ops.alias("op"), F.concat(F.lit("h"), (i % 3).cast("string")).alias("holder"), (1 + i % 4).alias("number"), (40 + i % 300).alias("term"))
    return journal.lease_fold(requests).withColumn("holder", F.coalesce("holder", F.lit("")))


_GENERATIONS = """g AS (SELECT p_partkey AS generation_id, 'c' || (p_partkey // 4) AS collection_id, CASE p_partkey % 4 WHEN 0 THEN 'published' WHEN 1 THEN CASE WHEN p_partkey % 3 = 0 THEN 'building' ELSE 'verified' END WHEN 2 THEN 'retired' ELSE 'failed' END AS state FROM part),
rq AS (SELECT p_partkey AS generation_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey - 1 END AS expected FROM part WHERE p_partkey % 4 = 1),
pb AS (SELECT g.collection_id, g.generation_id FROM rq JOIN g USING (generation_id) WHERE state = 'verified' AND expected IS NOT DISTINCT FROM (SELECT c.generation_id FROM g c WHERE c.collection_id = g.collection_id AND c.state = 'published'))"""


@query(f"WITH {_GENERATIONS} SELECT g.generation_id, g.collection_id, CASE WHEN g.generation_id = pb.generation_id THEN 'published' WHEN pb.generation_id IS NOT NULL AND state = 'published' THEN 'retired' ELSE state END AS state FROM g LEFT JOIN pb ON pb.collection_id = g.collection_id")
def published_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    state = F.when(i % 4 == 0, "published").when((i % 4 == 1) & (i % 3 == 0), "building").when(i % 4 == 1, "verified").when(i % 4 == 2, "retired").otherwise("failed")
    generations = parts.select(i.alias("generation_id"), F.concat(F.lit("c"), F.floor(i / 4).cast("string")).alias("collection_id"), state.alias("state"))
    requests = parts.where("p_partkey % 4 = 1").select(i.alias("generation_id"), F.when(i % 5 != 0, i - 1).alias("expected"))
    return journal.publish_if_current(generations, requests)[0]


@query("""SELECT 'collection/c' || (doc_id % 3) AS stream, 'revision.held.v1' AS type, '{"collection":"c' || (doc_id % 3) || '","revision":' || doc_id || ',"disposition":"quarantined"}' AS data FROM documents WHERE doc_id % 5 = 0""")
def public_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("collection"), F.col("doc_id").alias("revision"), F.lit("quarantined").alias("disposition"))
    return journal.public_events(rows, "revision.held")


# Identities, arbitration and support.

_SPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(
    f"""WITH h AS (SELECT doc_id, sha1(unhex('{_SPACE.replace('-', '')}') || encode('chunk-' || doc_id)) AS s FROM documents)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(s, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS point_id FROM h"""
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("chunk-"), F.col("doc_id").cast("string")).alias("name"))
    return named.select("doc_id", F.expr(blocks.point_id("name", _SPACE)).alias("point_id"))


@query("""SELECT source, sha256('{"source":"' || source || '","profile":"p/3","counter":"words","revisions":[' || string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) || ']}') AS chunk_set FROM documents GROUP BY source""")
def chunk_set_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chunk_set_identity(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "revision_id"), ["source"], "p/3", "words")


@query("SELECT sha256(text) AS digest, min(doc_id) AS chunk_id, count(*) AS members FROM documents GROUP BY 1")
def prepared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.prepared_groups(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id"))


@query("SELECT doc_id, code, CASE WHEN n > 1 THEN 'm (' || n || ' times)' ELSE 'm' END AS message FROM (SELECT user_id AS doc_id, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2)")
def finding_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("code"), F.lit("m").alias("message"))
    return blocks.finding_rollup(found, "doc_id")


@query(
    """WITH RECURSIVE c AS (SELECT l_orderkey AS id, l_linenumber % 3 AS priority, l_linenumber * 10 AS a, CAST(floor(l_linenumber * 10 + l_quantity / 2) AS BIGINT) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber, l_quantity) AS n FROM lineitem),
f AS (SELECT id, 1 AS n, [{'a': a, 'b': b}] AS taken FROM c WHERE n = 1 UNION ALL SELECT c.id, c.n, CASE WHEN len(list_filter(taken, lambda y: c.a < y.b AND y.a < c.b)) > 0 THEN taken ELSE list_append(taken, {'a': c.a, 'b': c.b}) END FROM f JOIN c ON c.id = f.id AND c.n = f.n + 1)
SELECT id, t.a AS span_start, t.b AS span_end FROM (SELECT id, unnest(taken) AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM f) WHERE r = 1)"""
)
def arbitrated_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    candidates = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (n % 3).alias("priority"), (n * 10).alias("start"), F.expr("cast(floor(l_linenumber * 10 + l_quantity / 2) as bigint)").alias("end"), F.lit("f").alias("family"), n.cast("string").alias("value"))
    return blocks.arbitrate(candidates).select("id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query(
    """SELECT doc_id AS question_id, doc_id % 6 = 0 AS supported, coalesce(CASE doc_id % 6 WHEN 1 THEN 'no citation' WHEN 2 THEN 'a citation of no passage' WHEN 3 THEN 'too short' WHEN 4 THEN 'a literal without support' WHEN 5 THEN 'a literal without support' END, '') AS reason FROM documents"""
)
def answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 6 == 0, "set --fast to 13 in `conf set` [1, 2]").when(i % 6 == 1, "set --fast to 13 now").when(i % 6 == 2, "set it to 13 [7]").when(i % 6 == 3, "to 13 [1]").when(i % 6 == 4, "set it to 3 now [1]").otherwise("edit /etc/other.conf for that [1]")
    d = table(spark, sf_dir, "documents").select("doc_id")
    answers = d.select(i.alias("question_id"), F.lit("which flag").alias("question"), text.alias("answer"))
    passages = d.select(i.alias("question_id"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("use --fast with 13, and edit /etc/app.conf").alias("text")), F.struct(F.lit(2).alias("n"), F.lit("or run conf set").alias("text")))).alias("p")).select("question_id", "p.*")
    return blocks.supported(answers, passages).select("question_id", "supported", F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT doc_id AS id, CASE WHEN json_type(m, '$.v') = 'VARCHAR' THEN json_extract_string(m, '$.v') ELSE '' END AS v FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{\"v\":\"a\"}' WHEN 1 THEN '{\"v\":1}' WHEN 2 THEN '{\"v\":true}' WHEN 3 THEN '{\"w\":\"a\"}' ELSE '{\"v\":null}' END AS m FROM documents)")
def typed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    metadata = F.when(i % 5 == 0, '{"v":"a"}').when(i % 5 == 1, '{"v":1}').when(i % 5 == 2, '{"v":true}').when(i % 5 == 3, '{"w":"a"}').otherwise('{"v":null}')
    return table(spark, sf_dir, "documents").select(i.alias("id"), metadata.alias("m")).select("id", F.coalesce(inventory.text_metadata("m", "v"), F.lit("")).alias("v"))
