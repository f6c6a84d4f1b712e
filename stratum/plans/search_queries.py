"""Registered queries of what protects a search, with DuckDB SQL: the guard on generated expansions, identifier spans, the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import identifiers, intent_guard
from stratum.functions import text as T
from stratum.operators import blocks, identifier_spans, vector_index
from stratum.plans.registry import query
from stratum.sources.tables import table

_ENDINGS = "|".join(intent_guard.ORDINAL_ENDINGS)


def _sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_tokens(x: str) -> str:
    words = f"list_filter(list_transform(string_split_regex(replace({x}, '’', ''''), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: lower(regexp_replace(w, '^''+|''+$', '', 'g'))), lambda w: w <> '' AND w NOT IN ({_sql_list(intent_guard.ARTICLES)}))"
    named = " ".join(f"WHEN w = '{k}' THEN '#{v}'" for k, v in intent_guard.QUANTITIES.items())
    return f"list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '^[0-9]+({_ENDINGS})?$') THEN '#' || regexp_extract(w, '^0*([0-9]+?)({_ENDINGS})?$', 1) {named} ELSE w END)"


_VARIANTS = ("q", "'Only after step: ' || text", "q || ' 42'", "'  '", "q || repeat(' word', 500)", "'ONLY after 3rd step ' || text")


def _passage() -> str:
    return "CASE v " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_VARIANTS)) + " END"


@query(f"""WITH s AS (SELECT conv_id, turn, coalesce(text, '') AS text, (conv_id + turn) % {len(_VARIANTS)} AS v, 'Only after the third step: ' || coalesce(text, '') AS q FROM conversations WHERE role = 'user'),
e AS (SELECT conv_id, turn, q, {_passage()} AS p FROM s),
t AS (SELECT *, {_sql_tokens('q')} AS qt, {_sql_tokens('p')} AS pt, {_sql_tokens("p || ' kw'")} AS gt FROM e),
qi AS (SELECT conv_id, turn, unnest(qt) AS w, unnest(list_concat(qt[2:], [NULL])) AS follow FROM t),
pi AS (SELECT conv_id, turn, unnest(pt) AS w, unnest(list_concat(pt[2:], [NULL])) AS follow FROM t),
lost AS (SELECT DISTINCT conv_id, turn FROM qi WHERE (w LIKE '#%' OR w IN ({_sql_list(intent_guard.CONSTRAINTS)}) OR w IN ({_sql_list(intent_guard.RELATIONS)}))
  AND NOT EXISTS (SELECT 1 FROM pi WHERE pi.conv_id = qi.conv_id AND pi.turn = qi.turn AND pi.w = qi.w AND (qi.w NOT IN ({_sql_list(intent_guard.RELATIONS)}) OR qi.follow IS NULL OR pi.follow = qi.follow))),
a AS (SELECT t.*, lost.conv_id IS NOT NULL AS missing, {identifiers.index_identifiers('q', T.DUCK)} AS qd, {identifiers.index_identifiers("p || ' kw'", T.DUCK)} AS gd FROM t LEFT JOIN lost ON lost.conv_id = t.conv_id AND lost.turn = t.turn)
SELECT conv_id, turn, CASE WHEN trim(p) = '' THEN 'empty' WHEN strlen(p) > 2048 THEN 'oversize' WHEN missing THEN 'protected_missing' WHEN len(list_filter(gt, lambda w: w LIKE '#%' AND NOT list_contains(qt, w))) > 0 THEN 'added_number'
  WHEN len(list_filter(qd, lambda x: NOT contains(p, x))) > 0 THEN 'identifier_missing' WHEN len(list_filter(gd, lambda x: NOT list_contains(qd, x))) > 0 THEN 'identifier_added' ELSE 'accepted' END AS verdict FROM a""")
def expansion_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as questions, each with an expansion that keeps it or breaks a rule."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    asked = turns.withColumns({"v": F.expr(f"(conv_id + turn) % {len(_VARIANTS)}"), "q": F.expr("'Only after the third step: ' || text")})
    return asked.withColumn("p", F.expr(_passage())).select("conv_id", "turn", F.expr(intent_guard.verdict("q", "p", "'kw'")).alias("verdict"))


@query()
def identifier_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of every document's whole text that stand after arbitration: how many of each family, and their digest in text order."""
    found = identifier_spans.spans(table(spark, sf_dir, "documents"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "value"))), lambda x: F.concat_ws(",", x["start"].cast("string"), x["end"].cast("string"), x["value"]))
    return blocks.arbitrate(found, "doc_id").groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


@query()
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every twentieth vector among all, through the index, each row with the recall of the whole search against the exact one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = vector_index.build(vectors)
    probes = vector_index.probes_for(index, vectors)
    measured = vector_index.recall(index, vectors, asked, 10, probes).select("recall")
    return vector_index.search(index, asked, 10, probes).crossJoin(F.broadcast(measured))
