"""What makes evidence of ranked candidates: policies, second passes, conflict and version classes, gaps and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators import retrieval
from stratum.operators.evidence import conflict_units, version_key
from stratum.operators.inventory import has_literal
from stratum.runtime import discard, settle


def apply_policies(reranked: DataFrame, weight: float | None = None, multiplier: Column | None = None, cap: int | None = None) -> DataFrame:
    """(query_id, chunk_id, place): the rank policies in their one order: blend of reranked and fused positions, soft priors, demotion cap. What is not given is left out."""
    held, place = reranked, "reranked"
    if weight is not None:
        held, place = retrieval.blend(held, weight, position=place), "blended"
    if multiplier is not None:
        held, place = retrieval.soft_demotion(held, multiplier, place), "demoted"
    if cap is not None:
        held, place = retrieval.cap_demotion(held, cap, place), "capped"
    return held.select("query_id", "chunk_id", F.col(place).alias("place"))


def second_pass(first: DataFrame, second: DataFrame, least_score: float | None = None) -> DataFrame:
    """(query_id, triggered, kept) of passes (query_id, top_score, reranked, candidates).

    A second pass runs where the first has no top score or one below ``least_score`` (None: always). It is kept if it was
    reranked or the first wasn't, and has candidates or the first hadn't; one that is missing is not.
    """
    other = second.select("query_id", F.col("reranked").alias("__r"), F.col("candidates").alias("__n"))
    triggered = F.lit(True) if least_score is None else F.coalesce(F.col("top_score") < least_score, F.lit(True))
    # A missing second pass has no count, and stays out even where the first had nothing.
    as_well = F.col("__n").isNotNull() & (F.col("__r") | ~F.col("reranked")) & ((F.col("__n") > 0) | (F.col("candidates") == 0))
    return first.join(other, "query_id", "left").select("query_id", triggered.alias("triggered"), F.when(triggered & F.coalesce(as_well, F.lit(False)), "second").otherwise("first").alias("kept"))


def rerank_windows(passages: DataFrame, key: list[str], text: str, budget: int) -> DataFrame:
    """(key, window, text) of passages in windows of at most ``budget`` words, cut after white space; put together they are the passage. An empty text has none."""
    pieces = F.expr(f"regexp_extract_all({text}, r'^\\s+|\\S+\\s*', 0)")
    cut = passages.select(*key, pieces.alias("p")).where(F.size("p") > 0)
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / budget).cast("int")), lambda i: F.array_join(F.slice("p", i * budget + 1, F.lit(budget)), ""))
    return cut.select(*key, F.posexplode(windows).alias("window", "text"))


def window_max(scores: DataFrame, key: list[str], score: str = "score") -> DataFrame:
    """A candidate's score is the greatest of its windows'."""
    return scores.groupBy(*key).agg(F.max(score).alias(score))


def conflict_findings(facts: DataFrame, partition: list[str]) -> DataFrame:
    """(partition, unit, candidates, values): candidates that state differing values of one thing and belong together.

    facts (partition, candidate, value, families: array): two candidates correspond if they share a family (a document or a
    near-duplicate group). In a family with two values or more each candidate differs from some other, so all of it is
    connected; classes are what such families connect, and no pairs are made.
    """
    held = facts.where("value IS NOT NULL").select(F.to_json(F.struct(*partition)).alias("__p"), *partition, "candidate", "value", F.explode("families").alias("group"))
    split = held.groupBy("__p", "group").agg(F.countDistinct("value").alias("n")).where("n > 1").select("__p", "group")
    differing = settle(held.join(split, ["__p", "group"], "left_semi"), "facts")
    units = conflict_units(differing.select("__p", "group", F.col("candidate").alias("chunk_id")), "__p").withColumnRenamed("chunk_id", "candidate")
    return differing.join(units, ["__p", "candidate"]).groupBy(*partition, "unit").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"), F.array_sort(F.collect_set("value")).alias("values"))


def version_classes(candidates: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, chunk_id, class): candidates (query, chunk_id, place, text, families: array) with the same text at the same place that families link, however long the chain; named by the smallest chunk."""
    linked = candidates.select(query, "chunk_id", F.explode("families").alias("f"), F.sha2(F.to_json(F.struct("place", "text")), 256).alias("h"))
    return conflict_units(linked.select(query, "chunk_id", F.to_json(F.struct("h", "f")).alias("group")), query).withColumnRenamed("unit", "class")


def collapsed_versions(candidates: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, chunk_id, class, status, winner): of a class of two revisions or more whose versions are all numeric, the greatest stand and strictly older ones are alternates of the first of these by chunk_id; a class with a version that can't be told is undecided."""
    w = Window.partitionBy(query, "class")
    keyed = candidates.join(version_classes(candidates, query), [query, "chunk_id"]).withColumn("__k", F.expr(version_key("version")))
    single = F.min("revision_id").over(w) == F.max("revision_id").over(w)
    unknown = F.max(F.col("__k").isNull()).over(w)
    top = F.max("__k").over(w)
    status = F.when(single, "current").when(unknown, "undecided").when(F.col("__k") < top, "alternate").otherwise("current")
    marked = keyed.withColumns({"status": status, "__top": F.col("__k") == top})
    winner = F.min(F.when(F.col("__top"), F.col("chunk_id"))).over(w)
    return marked.withColumn("winner", F.when(F.col("status") == "alternate", winner)).select(query, "chunk_id", "class", "status", "winner")


# The wording of evidence gaps.
NO_EVIDENCE = "No accessible evidence was returned for this query in the pinned generation."
NO_PASSAGES = "No source passages were returned; inventory totals are independent of supporting passages."
UNRESOLVED = "One or more candidate passages could not be resolved in the current scopes."
LATEST_UNKNOWN = "Latest version could not be determined for one or more candidate families."
OMITTED = "Some candidate evidence was omitted by the evidence or passage budget."
OMITTED_CONFLICT = "Conflicting values could not be retained together within the evidence or passage budget."


def known_gaps(questions: DataFrame, passages: DataFrame, identifiers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, position, gap) in order, each message once.

    questions (query_id, version, has_inventory, unresolved, latest_unknown, omitted, omitted_conflict), passages (query_id, n,
    text, version, windowed), identifiers (query_id, identifier) that are required, candidates (query_id, text) before budgeting.
    """
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    asked = identifiers.select("query_id", "identifier").distinct()
    within = lambda texts: asked.join(texts, "query_id").where(has_literal("text", "identifier")).select("query_id", "identifier").distinct()
    absent = asked.join(within(passages.select("query_id", "text")), ["query_id", "identifier"], "left_anti")
    seen = within(candidates.select("query_id", "text")).withColumn("seen", F.lit(True))
    message = F.concat(F.lit("Required identifier "), quoted(F.col("identifier")), F.when(F.col("seen"), " was found in candidates but is absent after budgeting.").otherwise(" is absent from returned passages."))
    missing = absent.join(seen, ["query_id", "identifier"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("identifier", message.alias("m")))).alias("ids"))
    held = passages.groupBy("query_id").agg(F.collect_set("version").alias("versions"), F.array_sort(F.collect_list(F.when(F.col("windowed"), F.col("n")))).alias("windows"), F.count(F.lit(1)).alias("n"))
    q = questions.join(held, "query_id", "left").join(missing, "query_id", "left")
    one = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.array(text if isinstance(text, Column) else F.lit(text))).otherwise(F.array().cast("array<string>"))
    each = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    gaps = F.concat(
        one(F.col("n").isNull(), F.when(F.col("has_inventory"), NO_PASSAGES).otherwise(NO_EVIDENCE)), one(F.col("unresolved"), UNRESOLVED), each("ids", lambda x: x["m"]),
        one(F.col("version").isNotNull() & ~F.coalesce(F.array_contains("versions", F.col("version")), F.lit(False)), F.concat(F.lit("Requested version "), quoted(F.col("version")), F.lit(" is not represented in returned passages."))),
        one(F.col("latest_unknown"), LATEST_UNKNOWN), each("windows", lambda n: F.concat(F.lit("Passage "), n.cast("string"), F.lit(" is a window; surrounding section text is omitted."))),
        one(F.col("omitted"), OMITTED), one(F.col("omitted_conflict"), OMITTED_CONFLICT),
    )
    return q.select("query_id", F.posexplode(F.array_distinct(gaps)).alias("position", "gap"))


def traces(passages: DataFrame, seeds: DataFrame, ordered_lists: DataFrame) -> DataFrame:
    """(query_id, n, score, routes, chunk_ids, procedural) of passages (query_id, n, revision_id, start, end).

    seeds (query_id, revision_id, start, end, chunk_id, score, routes): those that lie in the passage give its chunks, routes
    and greatest score. procedural: a whole ordered list (revision_id, start, end) lies in it.
    """
    p = passages.alias("p")
    s = seeds.withColumnsRenamed({"start": "s_start", "end": "s_end"}).alias("s")
    inside = p.join(s, ["query_id", "revision_id"]).where("start <= s_start AND s_end <= end")
    found = inside.groupBy("query_id", "n").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("routes")))).alias("routes"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    lists = ordered_lists.select("revision_id", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    whole = passages.join(lists, "revision_id").where("start <= l_start AND l_end <= end").select("query_id", "n", F.lit(True).alias("procedural")).distinct()
    return found.join(whole, ["query_id", "n"], "left").withColumn("procedural", F.coalesce("procedural", F.lit(False)))


def required_context(seeds: DataFrame, edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """(seed, unit, depth): what each seed unit needs above it: parents (unit, parent) of parents, each by its shortest way; a cycle ends where it closes. A hierarchy deeper than ``most_depth`` is an error."""
    found = settle(seeds.select(F.col("unit").alias("seed"), "unit", F.lit(0).alias("depth")).distinct(), "context")
    front = found
    for depth in range(1, most_depth + 2):
        up = front.join(edges, "unit").select("seed", F.col("parent").alias("unit")).distinct()
        fresh = settle(up.join(found, ["seed", "unit"], "left_anti").withColumn("depth", F.lit(depth)), "context")
        if fresh.isEmpty():
            return found
        whole = settle(found.unionByName(fresh), "context")
        discard(found, front if front is not found else None)
        found, front = whole, fresh
    raise ValueError(f"deeper than {most_depth}")
