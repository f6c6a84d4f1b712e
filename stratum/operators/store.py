"""Reads over the stored tables: documents, their revisions, dispositions, chunks, chunk sets and generations.

Joins are equi joins on ids and left to Catalyst; what a request names (ids, identifiers, grants) is the
small side, and its join is a semi join where only existence counts. An eligible revision has not failed and
is accepted, with warnings or without. A scope is a path ``collection/source``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import inventory


@dataclass(frozen=True)
class Store:
    """documents (document_id, collection_id, source_id), revisions (revision_id, document_id, status, metadata: JSON), dispositions
    (revision_id, disposition), chunks (chunk_id, chunk_set_id, revision_id), members (chunk_set_id, revision_id) and generations
    (generation_id, chunk_set_id, collection_id, state)."""

    documents: DataFrame
    revisions: DataFrame
    dispositions: DataFrame
    chunks: DataFrame
    members: DataFrame
    generations: DataFrame


def visible_documents(store: Store, grants: DataFrame) -> DataFrame:
    """Documents whose collection and source a grant covers."""
    return inventory.visible(store.documents.withColumn("path", F.concat_ws("/", "collection_id", "source_id")), grants).drop("path")


def owners(store: Store, grants: DataFrame | None = None, collection: str | None = None, version: str | None = None, set_name: str | None = None) -> DataFrame:
    """Eligible revisions with their documents, in the grants' scope (None: all) and of the collection, version and set that are named; versions and sets count only where the metadata has them as text."""
    documents = store.documents if grants is None else visible_documents(store, grants)
    if collection is not None:
        documents = documents.where(F.col("collection_id") == collection)
    held = store.revisions.join(documents, "document_id").join(store.dispositions, "revision_id").where(inventory.eligible())
    return held.where(inventory.matches_or_any(inventory.text_metadata("metadata", "version"), version) & inventory.matches_or_any(inventory.text_metadata("metadata", "set"), set_name))


def selected_members(store: Store, chunk_set: str, group_key: str, **wanted) -> DataFrame:
    """(document_id, group_value, revision_id) distinct: the members of a chunk set that ``owners`` lets through."""
    members = store.members.where(F.col("chunk_set_id") == chunk_set).select("revision_id")
    found = members.join(owners(store, **wanted), "revision_id")
    return found.select("document_id", inventory.text_metadata("metadata", group_key).alias("group_value"), "revision_id").distinct()


def member_inventory(store: Store, chunk_set: str, group_key: str, **wanted) -> DataFrame:
    """(value, documents, total) of a chunk set's members, by binary order, missing values last."""
    return inventory.inventory_groups(selected_members(store, chunk_set, group_key, **wanted), "group_value")


def check_inventory(groups: DataFrame, most_json: int = inventory.MOST_JSON) -> DataFrame:
    """(groups, documents, total, json_bytes, valid): groups of an exact partition add up to the total, and the compact JSON of an inventory is bounded."""
    body = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("value"), F.col("documents")))), {"ignoreNullFields": "false"})
    made = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.octet_length(body).cast("long").alias("json_bytes"))
    return made.withColumn("valid", (F.col("documents") == F.col("total")) & (F.col("json_bytes") <= most_json))


def member_supports(store: Store, chunk_set: str, group_key: str, **wanted) -> DataFrame:
    """The smallest chunk of each selected revision, by document and chunk, at most twenty."""
    chunks = store.chunks.where(F.col("chunk_set_id") == chunk_set).select("chunk_id", "revision_id")
    found = selected_members(store, chunk_set, group_key, **wanted).join(chunks, "revision_id")
    return found.groupBy("document_id", "revision_id").agg(F.min("chunk_id").alias("chunk_id")).orderBy("document_id", "chunk_id").limit(inventory.MOST_SUPPORTS)


def requested_chunks(store: Store, ids: DataFrame, chunk_set: str, **wanted) -> DataFrame:
    """The chunks of a set that are asked for (chunk_id) and whose owners are let through, once each."""
    asked = store.chunks.where(F.col("chunk_set_id") == chunk_set).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return asked.join(owners(store, **wanted).select("revision_id", "document_id"), "revision_id").select("chunk_id", "revision_id", "document_id").distinct()


def version_exists(store: Store, generation: str, version: str | None, **wanted) -> DataFrame:
    """(exists): whether a chunk of the generation's set has an owner of that version. No version: it does."""
    spark = store.chunks.sparkSession
    if version is None:
        return spark.range(1).select(F.lit(True).alias("exists"))
    pinned = store.generations.where(F.col("generation_id") == generation).select("chunk_set_id", F.col("collection_id").alias("__c")).distinct()
    held = store.chunks.join(pinned, "chunk_set_id").join(owners(store, version=version, **wanted), "revision_id").where(F.col("collection_id") == F.col("__c"))
    return held.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))


def identifier_chunks(store: Store, postings: DataFrame, wanted_ids: DataFrame, chunk_set: str, limit: int, **wanted) -> DataFrame:
    """(chunk_id, rank): chunks that have any of the identifiers, with owners that are let through, the ``limit`` smallest."""
    found = postings.join(wanted_ids.select("identifier").distinct(), "identifier", "left_semi").select("chunk_id").distinct()
    kept = requested_chunks(store, found, chunk_set, **wanted).select("chunk_id").distinct().orderBy("chunk_id").limit(limit)
    return kept.withColumn("rank", F.expr("row_number() over (order by chunk_id)"))


def locations(store: Store, generation: str) -> DataFrame:
    """(chunk_id, revision_id, document_id, collection_id) of a generation's chunks: distinct places; more than one for a chunk is ambiguous."""
    pinned = store.generations.where(F.col("generation_id") == generation).select("chunk_set_id", F.col("collection_id").alias("__c"))
    placed = store.chunks.join(pinned, "chunk_set_id").join(store.revisions.select("revision_id", "document_id"), "revision_id").join(store.documents, "document_id")
    return placed.where(F.col("collection_id") == F.col("__c")).select("chunk_id", "revision_id", "document_id", "collection_id").distinct()


def near_groups_seen(groups: DataFrame, store: Store, grants: DataFrame) -> DataFrame:
    """All members (group_id, revision_id, jaccard) of the near-duplicate groups that have a member the grants let see."""
    seen = store.revisions.join(visible_documents(store, grants), "document_id").select("revision_id")
    open_groups = groups.join(seen, "revision_id", "left_semi").select("group_id").distinct()
    return groups.join(open_groups, "group_id", "left_semi")


def chunk_sets_seen(store: Store, grants: DataFrame) -> DataFrame:
    """(chunk_set_id) of sets of which some chunk's document the grants let see: existence, so a semi join."""
    seen = store.revisions.join(visible_documents(store, grants), "document_id").select("revision_id")
    return store.chunks.join(seen, "revision_id", "left_semi").select("chunk_set_id").distinct()


def disposition_counts(store: Store) -> DataFrame:
    """(collection_id, status, disposition, revisions, documents): revisions without a disposition are a group of their own."""
    held = store.revisions.join(store.documents, "document_id").join(store.dispositions, "revision_id", "left")
    return held.groupBy("collection_id", "status", "disposition").agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("document_id").alias("documents"))


def expected_sections(expected: DataFrame, sections: DataFrame) -> DataFrame:
    """Expected (question_id, source_ref, heading_path: array, occurrence) with the ``section_id`` that has this name, and its number of matches: 0 is unknown, over 1 ambiguous."""
    keys = ["source_ref", "heading_path", "occurrence"]
    named = sections.groupBy(*keys).agg(F.min("section_id").alias("section_id"), F.count(F.lit(1)).alias("matches"))
    return expected.join(named, keys, "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))


def agreed_candidates(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked (query_id, chunk_id, revision_id) with what is stored of each chunk, and ``state``: loaded, missing, or disagrees where the index names another revision."""
    stored = chunks.select("chunk_id", F.col("revision_id").alias("stored_revision"))
    state = F.when(F.col("stored_revision").isNull(), "missing").when(F.col("stored_revision") != F.col("revision_id"), "disagrees").otherwise("loaded")
    return ranked.join(stored, "chunk_id", "left").withColumn("state", state)


def payload_scroll(points: DataFrame, condition: Column, limit: int, after: str | None = None) -> DataFrame:
    """One page: the ``limit`` smallest distinct chunks (chunk_id) of points that meet a payload condition, after the last page's last chunk."""
    held = points.where(condition)
    if after is not None:
        held = held.where(F.col("chunk_id") > after)
    return held.select("chunk_id").distinct().orderBy("chunk_id").limit(limit)


def identifier_legs(payload: DataFrame, kernel: DataFrame, limit: int) -> DataFrame:
    """(query_id, chunk_id, rank): the payload leg's hits first, then the kernel's that it hasn't, each in its own rank's order."""
    both = payload.select("query_id", "chunk_id", "rank", F.lit(0).alias("leg")).unionByName(kernel.select("query_id", "chunk_id", "rank", F.lit(1).alias("leg")))
    first = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("leg", "rank")).alias("at"))
    return first.withColumn("rank", F.expr("row_number() over (partition by query_id order by at.leg, at.rank, chunk_id)")).where(F.col("rank") <= limit).select("query_id", "chunk_id", "rank")


def structured_route(requests: DataFrame, supports: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, rank) for questions that ask for an inventory (``inventory`` not null): its supporting chunks, all scored 1."""
    asked = requests.where("inventory IS NOT NULL").select("query_id")
    return asked.crossJoin(F.broadcast(supports.select("chunk_id").limit(inventory.MOST_SUPPORTS))).withColumns({"score": F.lit(1.0), "rank": F.expr("row_number() over (partition by query_id order by chunk_id)")})


def pending_revisions(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Members of a chunk set that have no chunk in it yet: what an interrupted preparation still has to do."""
    return members.join(chunks.select("chunk_set_id", "revision_id"), ["chunk_set_id", "revision_id"], "left_anti")
