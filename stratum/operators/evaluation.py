"""Retrieval metrics, intervals, floors and comparisons of runs."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.numbering import numbered
from stratum.runtime import settle, ship

RESAMPLES = 2000
#: Rank discounts 1 / log2(rank + 1) of the first ten ranks.
DISCOUNTS = tuple(1 / math.log2(r + 1) for r in range(1, 11))
# Floors in percent, and seconds.
FLOORS = {"top10": 90, "top1": 70, "refused": 90, "citation": 90, "answered": 80}


def item_ranks(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """(question_id, unit, rank): the best rank of each expected group, or item without a group; null if it isn't retrieved.

    expected (question_id, item, group), ranked (question_id, item, rank). Copies in one group score once.
    """
    joined = expected.join(ranked, ["question_id", "item"], "left")
    unit = F.coalesce(F.concat(F.lit("g:"), F.col("group")), F.concat(F.lit("i:"), F.col("item").cast("string")))
    return joined.groupBy("question_id", unit.alias("unit")).agg(F.min("rank").alias("rank"))


def question_metrics(ranks: DataFrame) -> DataFrame:
    """(question_id, recall_5, recall_10, mrr_10, ndcg_10): recall is whether any unit is found; the ideal counts units that weren't."""
    gain = F.lit(0.0)
    for r, d in enumerate(DISCOUNTS, start=1):
        gain = gain + F.when(F.col("rank") == r, F.lit(d)).otherwise(0.0)
    ideal = F.lit(0.0)
    for r, d in enumerate(DISCOUNTS, start=1):
        ideal = ideal + F.when(F.col("n") >= r, F.lit(d)).otherwise(0.0)
    each = ranks.groupBy("question_id").agg(F.min("rank").alias("best"), F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n"))
    hit = lambda k: F.when(F.col("best") <= k, 1.0).otherwise(0.0)
    return each.select("question_id", hit(5).alias("recall_5"), hit(10).alias("recall_10"), F.when(F.col("best") <= 10, 1.0 / F.col("best")).otherwise(0.0).alias("mrr_10"), (F.col("gain") / ideal).alias("ndcg_10"))


def mean_metrics(questions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means, rounded to six digits, with the number of questions."""
    return questions.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("questions"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall_5", "recall_10", "mrr_10", "ndcg_10")))


def nearest_rank(values: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.95), by: list[str] | None = None) -> DataFrame:
    """Smallest value with at least that share at or below it."""
    return values.groupBy(*(by or [])).agg(*(F.expr(f"percentile_disc({s}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(s * 100)}") for s in shares))


def latency_cohorts(attempts: DataFrame) -> DataFrame:
    """(cohort, attempts, warm_ups, ok, failed, p50, p95, per_second): percentiles and rate are of successes that aren't warm-ups."""
    counted = ~F.col("warm_up")
    good = counted & F.col("ok")
    held = attempts.withColumn("__us", F.when(good, F.col("latency_us")))
    return held.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("warm_up")).alias("warm_ups"), F.count_if(good).alias("ok"), F.count_if(counted & ~F.col("ok")).alias("failed"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY __us)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY __us)").alias("p95"),
        F.round(F.try_divide(F.count_if(good) * 1e6, F.sum("__us")), 6).alias("per_second"),
    )


def failure_classes(ranks: DataFrame, routes: DataFrame, cutoffs: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(question_id, cutoff, class, missed_by): a question of which no unit is within the cut-off was misranked if some route had it, else not retrieved; missed_by: routes without it."""
    best = ranks.groupBy("question_id").agg(F.min("rank").alias("best"))
    seen = routes.groupBy("question_id").agg(F.max("found").alias("any"), F.array_sort(F.collect_set(F.when(~F.col("found"), F.col("route")))).alias("missed_by"))
    each = best.join(seen, "question_id", "left").select("*", F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff"))
    failed = each.where(F.col("best").isNull() | (F.col("best") > F.col("cutoff")))
    return failed.select("question_id", "cutoff", F.when(F.coalesce("any", F.lit(False)) | F.col("best").isNotNull(), "misranked").otherwise("not_retrieved").alias("class"), "missed_by")


def ladder(outcomes: DataFrame, floors: dict[str, int] | None = None) -> DataFrame:
    """(floor, passed, of, needed, met): needed is the ceiling of the floor's percent. outcomes (floor, passed), null passed: not asked."""
    need = F.lit(None).cast("long")
    for name, percent in (floors or FLOORS).items():
        need = F.when(F.col("floor") == name, F.ceil(F.lit(percent) * F.col("of") / 100).cast("long")).otherwise(need)
    counted = outcomes.where(F.col("passed").isNotNull()).groupBy("floor").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("of"))
    return counted.withColumn("needed", need).withColumn("met", F.col("passed") >= F.col("needed"))


def paired(first: DataFrame, second: DataFrame, metric: str) -> DataFrame:
    """(question_id, difference) of two runs; a question that only one has is an error."""
    joined = first.select("question_id", F.col(metric).alias("a")).join(second.select("question_id", F.col(metric).alias("b")), "question_id", "full")
    if not joined.where("a IS NULL OR b IS NULL").isEmpty():
        raise ValueError("the runs' questions differ")
    return joined.select("question_id", (F.col("b") - F.col("a")).alias("difference"))


#: Items of a stratum that one task holds, and resamples that it makes of them.
ITEM_BLOCK, RESAMPLE_BLOCK, DRAW_SLICE = 1 << 18, 250, 1 << 20


def _slots(values: DataFrame, columns: list[str], stratum: str, order: str) -> DataFrame:
    """(stratum, begin, size, total, block, at, columns) of each item: its place in its stratum, which begins at ``begin`` in the order of all ``total`` items. A written table; items with a null value are left out."""
    rows = values.select(F.col(stratum).alias("stratum"), F.col(order).alias("__o"), *(F.col(c).cast("double").alias(f"__{c}") for c in columns)).dropna(subset=[f"__{c}" for c in columns])
    placed = settle(numbered(rows, ["stratum", "__o"], "pos"), "items")
    strata = placed.groupBy("stratum").agg(F.min("pos").alias("begin"), F.count(F.lit(1)).alias("size")).alias("s")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    sized = placed.alias("p").join(strata, F.col("p.stratum").eqNullSafe(F.col("s.stratum"))).crossJoin(F.broadcast(total))
    at = F.col("pos") - F.col("begin")
    return sized.select("begin", "size", "total", F.floor(at / ITEM_BLOCK).alias("block"), at.alias("at"), *(f"__{c}" for c in columns))


def _resamples(slots: DataFrame, columns: list[str], seed: int, resamples: int) -> DataFrame:
    """(resample, t0, t1, ...): each column's sum over what the resample draws.

    Draws are those of one SplitMix64 sequence over the items in order: the state grows by a constant a draw, so any part of a
    resample may start where it would be reached. A task has one block of a stratum's items and some of the resamples; it
    makes the stratum's draws in slices and adds up those that fall into its block. Sums of blocks are added up by resample.
    """
    names = [f"t{i}" for i in range(len(columns))]
    parts = slots.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-resamples // RESAMPLE_BLOCK) - 1)))))

    def run(frame):
        import numpy as np
        import pandas as pd

        gamma, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
        frame = frame.sort_values("at")
        begin, size, total, part, first = (int(frame[c].iloc[0]) for c in ("begin", "size", "total", "part", "at"))
        held = frame[[f"__{c}" for c in columns]].to_numpy(float)
        low_word, m = np.uint64(0xFFFFFFFF), np.uint64(size)
        out = []
        for r in range(part * RESAMPLE_BLOCK, min((part + 1) * RESAMPLE_BLOCK, resamples)):
            sums = np.zeros(len(columns))
            for start in range(0, size, DRAW_SLICE):
                count = min(DRAW_SLICE, size - start)
                state = np.uint64((seed + (r * total + begin + start) * gamma) & mask) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(gamma)
                z = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                z ^= z >> np.uint64(31)
                # High word of draw * size, in two halves of 32 bits.
                high = (z >> np.uint64(32)) * m + (((z & low_word) * m) >> np.uint64(32))
                drawn = (high >> np.uint64(32)).astype(np.int64) - first
                sums += held[drawn[(drawn >= 0) & (drawn < len(held))]].sum(axis=0)
            out.append((r, *sums))
        return pd.DataFrame(out, columns=["resample", *names])

    ship(slots.sparkSession)
    each = parts.groupBy("begin", "block", "part").applyInPandas(run, ", ".join(["resample long", *(f"{n} double" for n in names)]))
    return each.groupBy("resample").agg(*(F.sum(n).alias(n) for n in names))


def _interval(values: DataFrame, columns: list[str], statistic: Callable, name: str, stratum: str, order: str, seed: int, resamples: int) -> DataFrame:
    """(name, low, high): the statistic of all items' totals, and its 2.5 and 97.5 nearest-rank percentiles over the resamples that have one. No items, no row. statistic takes the totals' columns."""
    slots = settle(_slots(values, columns, stratum, order), "slots")
    totals = [F.col(f"t{i}") for i in range(len(columns))]
    observed = slots.agg(*(F.sum(f"__{c}").alias(f"t{i}") for i, c in enumerate(columns)), F.count(F.lit(1)).alias("__n")).where("__n > 0").select(statistic(*totals).alias(name))
    drawn = _resamples(slots, columns, seed, resamples).select(statistic(*totals).alias("__s"))
    edges = drawn.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY __s)").alias(c) for p, c in ((0.025, "low"), (0.975, "high"))))
    return observed.crossJoin(F.broadcast(edges))


def _mean(n: Column, total: Column) -> Column:
    return F.try_divide(total, n)


def bootstrap_interval(values: DataFrame, value: str, stratum: str, order: str, seed: int, resamples: int = RESAMPLES) -> DataFrame:
    """(mean, low, high) of a stratified bootstrap: the mean, and the 2.5 and 97.5 nearest-rank percentiles of the resamples' means."""
    return _interval(values.withColumn("__n", F.lit(1)), ["__n", value], _mean, "mean", stratum, order, seed, resamples)


def clusters(attempts: DataFrame, value: str, covered: Column, key: str = "question_id") -> DataFrame:
    """(key, stratum, n, total): each question's attempts together; warm-ups count for nothing, and a question of warm-ups only is left out. stratum 0: answerable."""
    counted = covered & ~F.col("warm_up")
    each = attempts.groupBy(key).agg(F.min(F.when(F.col("answerable"), 0).otherwise(1)).alias("stratum"), F.count_if(counted).alias("n"), F.coalesce(F.sum(F.when(counted, F.col(value).cast("double"))), F.lit(0.0)).alias("total"), F.count_if(~F.col("warm_up")).alias("__any"))
    return each.where(F.col("__any") > 0).drop("__any")


def cluster_bootstrap(attempts: DataFrame, value: str, covered: Column, seed: int, key: str = "question_id", resamples: int = RESAMPLES) -> DataFrame:
    """(mean, low, high) over attempts, where a resample draws questions and keeps each one's attempts together. covered: the attempts that the metric is about."""
    return _interval(clusters(attempts, value, covered, key), ["n", "total"], _mean, "mean", "stratum", key, seed, resamples)


def paired_bootstrap(baseline: DataFrame, candidate: DataFrame, value: str, covered: Column, seed: int, key: str = "question_id", resamples: int = RESAMPLES) -> DataFrame:
    """(difference, low, high): the candidate's mean less the baseline's, both of the same resampled questions. A question that only one run has, or that they disagree on being answerable, is an error."""
    a = clusters(baseline, value, covered, key).toDF(key, "stratum", "n_a", "total_a")
    b = clusters(candidate, value, covered, key).toDF(key, "stratum_b", "n_b", "total_b")
    both = a.join(b, key, "full")
    if not both.where("stratum IS NULL OR stratum_b IS NULL OR stratum <> stratum_b").isEmpty():
        raise ValueError("the runs' questions differ")
    return _interval(both, ["n_a", "total_a", "n_b", "total_b"], lambda n_a, a, n_b, b: _mean(n_b, b) - _mean(n_a, a), "difference", "stratum", key, seed, resamples)


def answer_metrics(results: DataFrame) -> DataFrame:
    """(questions, recall_5, recall_10, mrr_10, ndcg_10, no_answer_accuracy, false_abstentions) of results that aren't warm-ups: ranking and false abstentions over answerable ones, no-answer accuracy over the others; null over none."""
    held = results.where(~F.col("warm_up"))
    over = lambda c, which: F.round(F.avg(F.when(which, F.col(c).cast("double"))), 6)
    yes, gone = F.col("answerable"), F.when(F.col("abstained"), 1.0).otherwise(0.0)
    return held.withColumn("__gone", gone).agg(
        F.count(F.lit(1)).alias("questions"), *(over(m, yes).alias(m) for m in ("recall_5", "recall_10", "mrr_10", "ndcg_10")), over("__gone", ~yes).alias("no_answer_accuracy"), over("__gone", yes).alias("false_abstentions")
    )


def time_floor(attempts: DataFrame, limit_us: int, share: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """(attempts, timeouts, p, met): the nearest-rank percentile of ``latency_us`` where a null (a timeout or missing row) ranks above every time; p is null where it falls on one."""
    ranked = attempts.withColumn("__t", F.coalesce(F.col("latency_us").cast("double"), F.lit(float("inf"))))
    out = ranked.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("latency_us").isNull()).alias("timeouts"), F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY __t)").alias("p"))
    return out.withColumn("p", F.when(F.col("p") < float("inf"), F.col("p").cast("long"))).withColumn("met", F.coalesce(F.col("p") <= limit_us, F.lit(False)))


def delivery_score(questions: DataFrame, expected: DataFrame, anchors: DataFrame) -> DataFrame:
    """(answerable, uncredited, delivered, fully_delivered, median_permille, composition_cases, compositions_delivered), one row.

    questions (question_id, answerable, credited); expected (question_id, revision_id, section_id, start, end, component) and
    anchors (question_id, revision_id, section_id, start, end). An anchor delivers a section of its revision if the section is
    whole (null id), has the same id, or their spans overlap. A question's coverage is its best section's share, in permille, that
    the union of its anchors covers; a section without a span is covered whole when delivered. Nothing of an uncredited question
    counts, and its coverage is 0. A composition is delivered when each of two or more named components is.
    """
    from stratum.operators.evidence import coverage

    asked = expected.join(questions.where("answerable AND credited").select("question_id"), "question_id", "left_semi")
    keyed = asked.withColumns({"__key": F.to_json(F.struct("question_id", "revision_id")), "__id": F.expr("row_number() over (partition by question_id, revision_id order by start, end, section_id, component)")})
    seen = anchors.withColumn("__key", F.to_json(F.struct("question_id", "revision_id")))
    x, y = keyed.alias("x"), seen.alias("y")
    touch = F.col("x.section_id").isNull() | (F.col("x.section_id") == F.col("y.section_id")) | (F.greatest("x.start", "y.start") < F.least("x.end", "y.end"))
    hit = x.join(y, (F.col("x.__key") == F.col("y.__key")) & F.coalesce(touch, F.lit(False)), "left_semi").select("__key", "__id", F.lit(True).alias("hit"))
    spanned = keyed.where("start < end").select("__key", F.col("__id").alias("id"), "start", "end")
    share = coverage(spanned, seen.where("start < end").select("__key", "start", "end"), "__key").select("__key", F.col("id").alias("__id"), "permille")
    each = keyed.join(hit, ["__key", "__id"], "left").join(share, ["__key", "__id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    each = each.withColumn("permille", F.coalesce("permille", F.when(F.col("hit"), 1000).otherwise(0)))
    parts = each.where("component IS NOT NULL").groupBy("question_id", "component").agg(F.max("hit").alias("hit")).groupBy("question_id").agg(F.count(F.lit(1)).alias("parts"), F.min("hit").alias("whole"))
    scored = each.groupBy("question_id").agg(F.max("hit").alias("hit"), F.max("permille").alias("permille")).join(parts, "question_id", "left")
    rows = questions.where("answerable").select("question_id", "credited").join(scored, "question_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("answerable"), F.count_if(~F.col("credited")).alias("uncredited"), F.count_if("hit").alias("delivered"), F.count_if(F.col("permille") == 1000).alias("fully_delivered"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce(permille, 0))").cast("long").alias("median_permille"), F.count_if(F.col("parts") > 1).alias("composition_cases"), F.count_if((F.col("parts") > 1) & F.col("whole")).alias("compositions_delivered"),
    )


def subgroups(questions: DataFrame) -> DataFrame:
    """A row for each group a question is in: its language, and ``cross_lingual`` where the passages' language is another."""
    groups = F.array(F.col("language"), F.when(F.col("language") != F.col("passage_language"), F.lit("cross_lingual")))
    return questions.withColumn("subgroup", F.explode(F.filter(groups, lambda g: g.isNotNull())))


def merge_attempts(scheduled: DataFrame, attempts: DataFrame) -> DataFrame:
    """Every scheduled (question_id, attempt) with its result, ``missing`` where there is none; an attempt that wasn't scheduled or came twice is an error."""
    keys = ["question_id", "attempt"]
    if not attempts.join(scheduled, keys, "left_anti").isEmpty() or not attempts.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("attempts that were not scheduled, or twice")
    return scheduled.select(*keys).join(attempts, keys, "left").withColumn("state", F.coalesce("state", F.lit("missing")))


def bundle_order(passages: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1: scored by score, unscored last, ties by number."""
    return passages.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("score").desc_nulls_last(), "n")))
