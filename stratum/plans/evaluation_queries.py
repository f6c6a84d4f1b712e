"""Registered queries of evaluation over made-up runs, with DuckDB SQL. Attempts are rows of ``events``; spans are those of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import evaluation
from stratum.plans import catalog
from stratum.plans.registry import query
from stratum.sources.tables import table

_ATTEMPTS = """att AS (SELECT event_id, event_id % 97 AS question_id, event_id % 97 % 5 <> 0 AS answerable, event_id % 4 = 0 AS abstained, event_id % 10 = 0 AS warm_up,
  CAST(event_id * 37 % 101 AS DOUBLE) / 100 AS v, CAST(event_id * 53 % 103 AS DOUBLE) / 100 AS w, CASE WHEN event_id % 23 <> 0 THEN event_id * 7919 % 100003 END AS latency_us, CASE event_id % 97 % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'de' END AS language, CASE event_id % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS passage_language FROM events)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    q = i % 97
    return table(spark, sf_dir, "events").select(
        i.alias("event_id"), q.alias("question_id"), (q % 5 != 0).alias("answerable"), (i % 4 == 0).alias("abstained"), (i % 10 == 0).alias("warm_up"), ((i * 37 % 101).cast("double") / 100).alias("v"), ((i * 53 % 103).cast("double") / 100).alias("w"),
        F.when(i % 23 != 0, i * 7919 % 100003).alias("latency_us"), F.when(q % 3 == 0, "fr").when(q % 3 == 1, "en").otherwise("de").alias("language"), F.when(i % 2 == 0, "en").otherwise("fr").alias("passage_language"),
    )


_CLUSTERS = "SELECT question_id AS key, min(CASE WHEN answerable THEN 0 ELSE 1 END) AS stratum, count(*) FILTER (WHERE answerable AND NOT warm_up) AS {n}, coalesce(sum({v}) FILTER (WHERE answerable AND NOT warm_up), 0) AS {t} FROM att GROUP BY question_id HAVING count(*) FILTER (WHERE NOT warm_up) > 0"


@query(f"WITH {_ATTEMPTS}, vs AS ({_CLUSTERS.format(n='m', v='v', t='t')}), {catalog.bootstrap_sql('vs', 'm, t', 'sum(t) / sum(m)')}")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rounded(evaluation.cluster_bootstrap(_attempts(spark, sf_dir), "v", F.col("answerable"), 20260927))


@query(
    f"""WITH {_ATTEMPTS}, va AS ({_CLUSTERS.format(n='m', v='v', t='t')}), vb AS ({_CLUSTERS.format(n='mb', v='w', t='tb')}), vs AS (SELECT va.key, va.stratum, m, t, mb, tb FROM va JOIN vb ON va.key = vb.key),
{catalog.bootstrap_sql('vs', 'm, t, mb, tb', 'sum(tb) / sum(mb) - sum(t) / sum(m)', 'difference')}"""
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _attempts(spark, sf_dir)
    return catalog.rounded(evaluation.paired_bootstrap(held, held.withColumn("v", F.col("w")), "v", F.col("answerable"), 20260927))


@query(f"WITH {_ATTEMPTS}, a AS (SELECT question_id, avg(v) AS v FROM att GROUP BY 1), b AS (SELECT question_id, avg(w) AS v FROM att GROUP BY 1) SELECT question_id, round(b.v - a.v, 9) AS difference FROM a JOIN b USING (question_id)")
def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _attempts(spark, sf_dir).groupBy("question_id")
    return evaluation.paired(held.agg(F.avg("v").alias("m")), held.agg(F.avg("w").alias("m")), "m").withColumn("difference", F.round("difference", 9))


@query(
    f"""WITH {_ATTEMPTS} SELECT count(*) AS questions, round(avg(CASE WHEN v > 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6) AS recall_5, round(avg(CASE WHEN v > 0.2 THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6) AS recall_10, round(avg(v) FILTER (WHERE answerable), 6) AS mrr_10, round(avg(w) FILTER (WHERE answerable), 6) AS ndcg_10,
round(avg(CASE WHEN abstained THEN 1.0 ELSE 0 END) FILTER (WHERE NOT answerable), 6) AS no_answer_accuracy, round(avg(CASE WHEN abstained THEN 1.0 ELSE 0 END) FILTER (WHERE answerable), 6) AS false_abstentions FROM att WHERE NOT warm_up"""
)
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _attempts(spark, sf_dir)
    return evaluation.answer_metrics(held.select("answerable", "abstained", "warm_up", (F.col("v") > 0.5).cast("int").alias("recall_5"), (F.col("v") > 0.2).cast("int").alias("recall_10"), F.col("v").alias("mrr_10"), F.col("w").alias("ndcg_10")))


@query(f"WITH {_ATTEMPTS}, p AS (SELECT language, count(*) AS attempts, count(*) FILTER (WHERE latency_us IS NULL) AS timeouts, quantile_disc(coalesce(CAST(latency_us AS DOUBLE), 'infinity'), 0.95) AS p FROM att GROUP BY language) SELECT language, attempts, timeouts, CASE WHEN p < 'infinity' THEN CAST(p AS BIGINT) END AS p, p <= 99000 AS met FROM p")
def time_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.time_floor(_attempts(spark, sf_dir), 99_000, by=["language"])


@query(f"WITH {_ATTEMPTS} SELECT language, quantile_disc(latency_us, 0.5) AS p50, quantile_disc(latency_us, 0.95) AS p95 FROM att GROUP BY language")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.nearest_rank(_attempts(spark, sf_dir), "latency_us", by=["language"])


@query(f"WITH {_ATTEMPTS} SELECT subgroup, count(*) AS attempts, count(DISTINCT question_id) AS questions FROM (SELECT question_id, language AS subgroup FROM att UNION ALL SELECT question_id, 'cross_lingual' FROM att WHERE language <> passage_language) GROUP BY subgroup")
def subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subgroups(_attempts(spark, sf_dir)).groupBy("subgroup").agg(F.count(F.lit(1)).alias("attempts"), F.countDistinct("question_id").alias("questions"))


@query(
    f"""WITH {_ATTEMPTS}, best AS (SELECT question_id, CASE WHEN min(event_id) % 3 = 0 THEN NULL ELSE min(event_id) % 14 END AS best FROM att GROUP BY 1),
r AS (SELECT question_id, route, bool_or(event_id % 7 = 0) AS found FROM att, (VALUES ('dense'), ('lexical')) AS t(route) WHERE route = 'dense' OR event_id % 3 = 0 GROUP BY 1, 2),
s AS (SELECT question_id, bool_or(found) AS seen, array_to_string(list(route ORDER BY route) FILTER (WHERE NOT found), ',') AS missed_by FROM r GROUP BY 1)
SELECT best.question_id, cutoff, CASE WHEN coalesce(seen, false) OR best IS NOT NULL THEN 'misranked' ELSE 'not_retrieved' END AS class, coalesce(missed_by, '') AS missed_by FROM best LEFT JOIN s USING (question_id), (VALUES (5), (10)) AS c(cutoff) WHERE best IS NULL OR best > cutoff"""
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _attempts(spark, sf_dir)
    least = F.min("event_id")
    ranks = held.groupBy("question_id").agg(F.when(least % 3 != 0, least % 14).alias("rank"))
    routes = held.select("question_id", "event_id", F.explode(F.array(F.lit("dense"), F.lit("lexical"))).alias("route")).where("route = 'dense' OR event_id % 3 = 0")
    found = routes.groupBy("question_id", "route").agg(F.max(F.col("event_id") % 7 == 0).alias("found"))
    return evaluation.failure_classes(ranks, found).select("question_id", "cutoff", "class", F.coalesce(F.array_join("missed_by", ","), F.lit("")).alias("missed_by"))


@query("SELECT q AS question_id, a AS attempt, CASE WHEN event_id IS NULL THEN 'missing' ELSE 'done' END AS state FROM range(50) AS t(q), range(4) AS u(a) LEFT JOIN events ON event_id = q * 4 + a AND event_id % 3 <> 0")
def merged_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheduled = spark.range(200).select(F.floor(F.col("id") / 4).alias("question_id"), (F.col("id") % 4).alias("attempt"))
    done = table(spark, sf_dir, "events").where("event_id < 200 AND event_id % 3 <> 0").select(F.floor(F.col("event_id") / 4).alias("question_id"), (F.col("event_id") % 4).alias("attempt"), F.lit("done").alias("state"))
    return evaluation.merge_attempts(scheduled, done)


@query(f"WITH {_ATTEMPTS} SELECT question_id, event_id, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN event_id % 6 <> 0 THEN v END DESC NULLS LAST, event_id) AS rank FROM att")
def bundle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _attempts(spark, sf_dir).select("question_id", F.col("event_id").alias("n"), F.when(F.col("event_id") % 6 != 0, F.col("v")).alias("score"))
    return evaluation.bundle_order(held).select("question_id", F.col("n").alias("event_id"), "rank")


_SECTIONS = """q AS (SELECT o_orderkey AS question_id, o_orderkey % 9 <> 0 AS answerable, o_orderkey % 7 <> 0 AS credited FROM orders),
x AS (SELECT question_id, question_id AS revision_id, 's' || k AS section_id, CASE WHEN k < 2 THEN k * 60 END AS a, CASE WHEN k < 2 THEN k * 60 + 40 END AS b, CASE WHEN question_id % 2 = 0 THEN 'part' || k END AS component, k FROM q, range(3) AS t(k) WHERE k <= question_id % 3 AND answerable AND credited)"""


@query(
    f"""WITH {catalog._SPANS}, {catalog._UNION}, {_SECTIONS},
h AS (SELECT x.question_id, x.k, x.component, a, b, EXISTS (SELECT 1 FROM spans WHERE spans.revision_id = x.revision_id AND ('s' || (spans."start" // 20)) = x.section_id) OR EXISTS (SELECT 1 FROM spans WHERE spans.revision_id = x.revision_id AND greatest(spans."start", a) < least(spans."end", b)) AS hit FROM x),
cv AS (SELECT x.question_id, x.k, sum(least(b, "end") - greatest(a, "start")) AS covered FROM x JOIN united ON united.revision_id = x.revision_id AND greatest(a, "start") < least(b, "end") GROUP BY 1, 2),
e AS (SELECT h.*, CASE WHEN a IS NULL THEN CASE WHEN hit THEN 1000 ELSE 0 END ELSE coalesce(covered, 0) * 1000 // (b - a) END AS permille FROM h LEFT JOIN cv ON cv.question_id = h.question_id AND cv.k = h.k),
p AS (SELECT question_id, count(*) AS parts, bool_and(hit) AS whole FROM (SELECT question_id, component, bool_or(hit) AS hit FROM e WHERE component IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT question_id, bool_or(hit) AS hit, max(permille) AS permille FROM e GROUP BY 1)
SELECT count(*) AS answerable, count(*) FILTER (WHERE NOT credited) AS uncredited, count(*) FILTER (WHERE hit) AS delivered, count(*) FILTER (WHERE permille = 1000) AS fully_delivered, CAST(quantile_disc(coalesce(permille, 0), 0.5) AS BIGINT) AS median_permille,
count(*) FILTER (WHERE parts > 1) AS composition_cases, count(*) FILTER (WHERE parts > 1 AND whole) AS compositions_delivered FROM q LEFT JOIN s USING (question_id) LEFT JOIN p USING (question_id) WHERE answerable"""
)
def delivery_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    questions = orders.select(k.alias("question_id"), (k % 9 != 0).alias("answerable"), (k % 7 != 0).alias("credited"))
    n = F.col("k")
    expected = orders.select(k.alias("question_id"), k.alias("revision_id"), F.explode(F.sequence(F.lit(0).cast("long"), k % 3)).alias("k")).select(
        "question_id", "revision_id", F.concat(F.lit("s"), n.cast("string")).alias("section_id"), F.when(n < 2, n * 60).alias("start"), F.when(n < 2, n * 60 + 40).alias("end"), F.when(F.col("question_id") % 2 == 0, F.concat(F.lit("part"), n.cast("string"))).alias("component")
    )
    spans = catalog._spans(spark, sf_dir)
    anchors = spans.select(F.col("revision_id").alias("question_id"), "revision_id", F.concat(F.lit("s"), F.floor(F.col("start") / 20).cast("string")).alias("section_id"), "start", "end")
    return evaluation.delivery_score(questions, expected, anchors)
