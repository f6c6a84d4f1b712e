"""Scopes, eligibility, counts and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELIGIBLE = ("accepted", "accepted_with_warnings")
MOST_GROUPS, MOST_SUPPORTS, MOST_JSON = 1000, 20, 32_768


def covers(grant: str | Column, path: str | Column) -> Column:
    """A grant covers its path and all below it, by whole segments."""
    g = F.col(grant) if isinstance(grant, str) else grant
    p = F.col(path) if isinstance(path, str) else path
    return (p == g) | F.startswith(p, F.concat(g, F.lit("/")))


def visible(rows: DataFrame, grants: DataFrame, path: str = "path", granted: str = "grant") -> DataFrame:
    """Rows whose path a grant covers: an equi semi join of each path's ancestors, so no nested loop over rows and grants."""
    segments = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    paths = rows.select(path).distinct()
    seen = paths.select(path, F.explode(above).alias("__g")).join(grants.select(F.col(granted).alias("__g")).distinct(), "__g", "left_semi").select(path).distinct()
    return rows.join(seen, path, "left_semi")


def latest(revisions: DataFrame, document: str = "document_id", order: str = "record_seq") -> DataFrame:
    """The last revision of each document, whatever its state."""
    w = Window.partitionBy(document).orderBy(F.desc(order))
    return revisions.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def eligible(status: str = "status", disposition: str = "disposition") -> Column:
    return (F.col(status) != "failed") & F.col(disposition).isin(*ELIGIBLE)


def latest_eligible(revisions: DataFrame, document: str = "document_id", order: str = "record_seq") -> DataFrame:
    """Latest first, eligibility second: an older accepted revision never stands in for a newer failed one."""
    return latest(revisions, document, order).where(eligible())


def left_out(revisions: DataFrame, document: str = "document_id", order: str = "record_seq") -> DataFrame:
    """Documents whose latest revision isn't eligible, with the reason: failed, else the disposition, else undecided."""
    reason = F.when(F.col("status") == "failed", "failed").otherwise(F.coalesce("disposition", F.lit("undecided")))
    return latest(revisions, document, order).where(~F.coalesce(eligible(), F.lit(False))).withColumn("reason", reason)


def text_metadata(column: str, key: str) -> Column:
    """A JSON object's value where it is text; numbers, booleans and the rest count as missing. The key is looked up as it is, so it may hold dots and quotes."""
    members = F.expr(f"try_variant_get(try_parse_json({column}), '$', 'map<string, variant>')")
    value = F.try_element_at(members, F.lit(key))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def matches_or_any(column: Column, wanted: str | None) -> Column:
    """No wanted value: no filter."""
    return F.lit(True) if wanted is None else F.coalesce(column == wanted, F.lit(False))


def collection_counts(revisions: DataFrame) -> DataFrame:
    """(status, disposition, revisions): a missing disposition is a group of its own."""
    return revisions.groupBy("status", "disposition").agg(F.count(F.lit(1)).alias("revisions"))


def inventory_groups(rows: DataFrame, by: str, document: str = "document_id", most: int = MOST_GROUPS) -> DataFrame:
    """(value, documents, total) by binary order of the value, null last; over ``most`` groups are refused."""
    grouped = rows.groupBy(F.col(by).alias("value")).agg(F.countDistinct(document).alias("documents"))
    if grouped.limit(most + 1).count() > most:
        raise ValueError(f"over {most} groups")
    total = rows.agg(F.countDistinct(document).alias("total"))
    return grouped.join(F.broadcast(total), how="cross").orderBy(F.col("value").asc_nulls_last())


def inventory_supports(chunks: DataFrame, document: str = "document_id", revision: str = "revision_id", chunk: str = "chunk_id", most: int = MOST_SUPPORTS) -> DataFrame:
    """The first chunk of each revision, in order, at most ``most``."""
    return chunks.groupBy(document, revision).agg(F.min(chunk).alias("chunk_id")).orderBy(document, revision).limit(most)


def too_common(postings: DataFrame, limit: int) -> DataFrame:
    """Identifiers in over ``limit`` chunks, with the count."""
    return postings.groupBy("identifier").agg(F.countDistinct("chunk_id").alias("chunks")).where(F.col("chunks") > limit)


def ambiguous(locations: DataFrame, key: str) -> DataFrame:
    """Keys with more than one distinct location."""
    return locations.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("locations")).where("locations > 1")


def has_literal(text: str | Column, atom: str | Column) -> Column:
    """Whether an identifier is in a text by itself: no identifier character touches it, and a final dot only ends it if no such character follows."""
    text, atom = (F.col(x) if isinstance(x, str) else x for x in (text, atom))
    edge = r"[\p{L}\p{N}_\-/\\:]"
    quoted = F.replace(atom, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_like(text, F.concat(F.lit(rf"(?<!{edge}|[\p{{L}}\p{{N}}]\.)\Q"), quoted, F.lit(rf"\E(?!{edge})(?!\.[\p{{L}}\p{{N}}])")))
