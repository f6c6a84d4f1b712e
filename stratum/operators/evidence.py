"""Spans, sections, packing, conflicts, version collapse and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.runtime import discard, settle, ship

CLOSE_AT, MOST_TOKENS, SMALL = 500, 700, 150
MMR_RELEVANCE, MMR_REDUNDANCY = 0.7, 0.3
# Words that make a table row conditional.
CONDITIONS = """if unless when only except provided requires require must before after not no never without cannot neither nor
si sauf lorsque quand uniquement avant après doit doivent nécessite ne pas jamais sans aucun aucune ni""".split()


def span_union(spans: DataFrame, key: str = "revision_id") -> DataFrame:
    """(key, start, end, parts): overlapping and touching half-open spans of a revision become one."""
    w = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = spans.withColumn("__new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    island = flagged.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "__i").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("__i")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Pairs of half-open spans of one key that overlap: left (key, l_id, l_start, l_end), right (key, r_id, r_start, r_end). Spans are put into bins of ``width``; a pair is taken where it first meets."""
    bins = lambda d, s, e: d.where(F.col(e) > F.col(s)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))
    met = bins(left, "l_start", "l_end").join(bins(right, "r_start", "r_end"), [key, "__bin"])
    first = F.floor(F.greatest("l_start", "r_start") / width)
    return met.where((F.greatest("l_start", "r_start") < F.least("l_end", "r_end")) & (F.col("__bin") == first)).drop("__bin")


def coverage(expected: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """(key, id, wanted, covered, permille) of each expected span (key, id, start, end) by the union of the delivered ones (key, start, end)."""
    union = span_union(delivered, key).select(key, F.monotonically_increasing_id().alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    left = expected.select(key, F.col("id").alias("l_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    got = overlapping(left, union, key).groupBy(key, F.col("l_id").alias("id")).agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("covered"))
    out = expected.join(got, [key, "id"], "left").select(key, "id", (F.col("end") - F.col("start")).alias("wanted"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))
    return out.withColumn("permille", F.when(F.col("wanted") > 0, F.floor(F.col("covered") * 1000 / F.col("wanted"))).otherwise(0).cast("long"))


def occurrence_numbers(blocks: DataFrame, document: str, path: str, position: str) -> DataFrame:
    """Adds ``occurrence``, from 1, of a repeated heading path in document order."""
    return blocks.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, path).orderBy(position)))


def consecutive_groups(atoms: DataFrame, document: str, position: str, key: str) -> DataFrame:
    """Adds ``idea``: neighbours with equal key have one number, counted from 0."""
    w = Window.partitionBy(document).orderBy(position)
    changed = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return atoms.withColumn("__c", changed).withColumn("idea", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__c")


def section_extents(headings: DataFrame, lengths: DataFrame, document: str = "document_id") -> DataFrame:
    """Adds ``extent_end``: start of the next heading of equal or smaller level, else the document's length. Levels are six at most, so the next start of each is one window."""
    w = Window.partitionBy(document).orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= n, F.min(F.when(F.col("level") == n, F.col("start"))).over(w)) for n in range(1, 7)]
    return headings.join(lengths, document).withColumn("extent_end", F.coalesce(F.least(*nexts), F.col("length"))).drop("length")


def heading_paths(headings: DataFrame, document: str = "document_id") -> DataFrame:
    """Adds ``heading_path``: titles of the headings above and the heading's own, by the last heading of each smaller level that nothing shallower has closed."""
    w = Window.partitionBy(document).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    last = {n: F.max(F.when(F.col("level") == n, F.struct("start", "title"))).over(w) for n in range(1, 7)}
    out = headings.withColumns({f"__l{n}": c for n, c in last.items()})
    parts = []
    for n in range(1, 7):
        opened = F.col(f"__l{n}")
        closed = F.lit(False)
        for m in range(1, n):
            closed = closed | (F.col(f"__l{m}").isNotNull() & (F.col(f"__l{m}")["start"] > opened["start"]))
        parts.append(F.when(opened.isNotNull() & ~closed & (F.col("level") >= n), opened["title"]))
    return out.withColumn("heading_path", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop(*(f"__l{n}" for n in range(1, 7)))


def deepest_section(spans: DataFrame, sections: DataFrame, key: str = "document_id", width: int = 4096) -> DataFrame:
    """(span_id, section_id): of the sections that hold a span the one that starts last, then ends first; null if none does.

    A section that holds a span holds its start, so sections stand in all their bins of ``width`` and a span in one: a span meets
    the sections about it, not all of its document.
    """
    binned = sections.where("section_start <= section_end").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("section_start") / width), F.floor(F.col("section_end") / width))))
    held = spans.withColumn("__bin", F.floor(F.col("start") / width)).join(binned, [key, "__bin"]).where("section_start <= start AND end <= section_end")
    best = held.groupBy("span_id").agg(F.min(F.struct((-F.col("section_start")).alias("a"), F.col("section_end").alias("b"), "section_id"))["section_id"].alias("section_id"))
    return spans.join(best, "span_id", "left").select("span_id", "section_id")


def sibling_window(blocks: DataFrame, parent: str, position: str, each_side: int = 2) -> DataFrame:
    """Adds ``neighbours``: ids before and after in turn, nearest first, at most ``each_side`` a side."""
    w = Window.partitionBy(parent).orderBy(position)
    turns = [c for k in range(1, each_side + 1) for c in (F.lag("block_id", k).over(w), F.lead("block_id", k).over(w))]
    return blocks.withColumn("neighbours", F.filter(F.array(*turns), lambda x: x.isNotNull()))


def greedy_pack(units: DataFrame, document: str, position: str, tokens: str, close_at: int = CLOSE_AT, most: int = MOST_TOKENS, small: int = SMALL) -> DataFrame:
    """(document, chunk, first, last, tokens): units in order join a draft while it stays within ``most``; a draft of ``close_at`` closes; a draft under ``small`` joins the one before if both fit. A longer unit is a draft of its own.

    Drafts depend on all before them in a document, so a document's units are folded, whatever their number.
    """
    listed = units.groupBy(document).agg(F.array_sort(F.collect_list(F.struct(F.col(position).cast("long").alias("p"), F.col(tokens).cast("long").alias("t")))).alias("u"))
    kind = "array<struct<first:bigint,last:bigint,tokens:bigint>>"
    grown = "struct(element_at(s, -1).first as first, x.p as last, element_at(s, -1).tokens + x.t as tokens)"
    fold = f"""aggregate(u, cast(array() as {kind}), (s, x) ->
        if(size(s) > 0 and s[greatest(size(s) - 1, 0)].tokens < {close_at} and s[greatest(size(s) - 1, 0)].tokens + x.t <= {most},
            concat(slice(s, 1, size(s) - 1), array({grown})), concat(s, array(struct(x.p as first, x.p as last, x.t as tokens)))))"""
    absorb = f"""aggregate(drafts, cast(array() as {kind}), (s, x) ->
        if(size(s) > 0 and x.tokens < {small} and s[greatest(size(s) - 1, 0)].tokens + x.tokens <= {most},
            concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).first as first, x.last as last, element_at(s, -1).tokens + x.tokens as tokens))), concat(s, array(x))))"""
    packed = listed.withColumn("drafts", F.expr(fold)).select(document, F.posexplode(F.expr(absorb)).alias("chunk", "c"))
    return packed.select(document, F.col("chunk").cast("long").alias("chunk"), F.col("c.first").alias("first"), F.col("c.last").alias("last"), F.col("c.tokens").alias("tokens"))


def conflicts(facts: DataFrame, partition: list[str], value: str) -> DataFrame:
    """(partition, n_values, candidates): groups of facts about one thing with differing values. Null values are no facts."""
    held = facts.where(F.col(value).isNotNull())
    return held.groupBy(*partition).agg(F.countDistinct(value).alias("n_values"), F.count(F.lit(1)).alias("candidates")).where("n_values > 1")


def is_conditional(text: str) -> str:
    """SQL: whether a text has a condition or negation word."""
    words = ", ".join(f"'{w}'" for w in CONDITIONS)
    return f"(arrays_overlap(split(lower({text}), r'[^\\p{{L}}]+'), array({words})) or lower({text}) rlike r'n[\\x27’]t($|[^\\p{{L}}\\p{{N}}])')"


def table_facts(rows: DataFrame, table: str, cells: list[str]) -> DataFrame:
    """Rows of the tables of which no row has a blank cell or a condition or negation."""
    bad = F.lit(False)
    for c in cells:
        bad = bad | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "") | F.coalesce(F.expr(is_conditional(c)), F.lit(True))
    return rows.withColumn("__bad", F.max(bad).over(Window.partitionBy(table))).where(~F.col("__bad")).drop("__bad")


def version_key(version: str) -> str:
    """SQL: a dotted version's numbers, of any size and number, as an array that orders as they do; missing ones are 0; null if it isn't one."""
    digits = f"regexp_replace(regexp_extract({version}, r'^[vV]?([0-9]+(?:\\.[0-9]+)*)$', 1), r'(\\.0+)+$', '')"
    part = "regexp_replace(x, '^0+', '')"
    return f"if({digits} = '' or {digits} is null, null, transform(split({digits}, r'\\.'), x -> struct(length({part}) as n, {part} as d)))"


def version_collapse(passages: DataFrame, family: list[str], version: str, identity: str) -> DataFrame:
    """Adds ``winner`` and ``status`` (current, alternate, undecided): of passages with one family and text in two revisions or more, the greatest version stands, older ones are its alternates; what has no version can't be told. Single ones are current."""
    w = Window.partitionBy(*family)
    keyed = passages.withColumn("__k", F.expr(version_key(version)))
    top = F.max(F.struct("__k", F.col(identity).alias("id"))).over(w)
    many = F.min(identity).over(w) != F.max(identity).over(w)
    status = F.when(~many, "current").when(F.col("__k").isNull() | (F.max("__k").over(w).isNull()), "undecided").when(F.col("__k") < F.max("__k").over(w), "alternate").otherwise("current")
    return keyed.withColumns({"status": status, "winner": F.when(status == "alternate", top["id"])}).drop("__k")


def conflict_units(memberships: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, chunk_id, unit): conflict groups (query, group, chunk_id) that share a chunk become one unit, named by its smallest chunk.

    Labels are spread over the groups until none changes; each round's table is written, so lineage stays short.
    """
    held = settle(memberships.select(query, "group", "chunk_id").distinct(), "conflict-groups")
    written = settle(held.groupBy(query, "chunk_id").agg(F.min("chunk_id").alias("unit")), "units")
    while True:
        labels = written.select(query, "chunk_id", "unit")
        by_group = held.join(labels, [query, "chunk_id"]).groupBy(query, "group").agg(F.min("unit").alias("least"))
        fresh = held.join(by_group, [query, "group"]).groupBy(query, "chunk_id").agg(F.min("least").alias("unit"))
        after = settle(fresh.join(labels.withColumnRenamed("unit", "was"), [query, "chunk_id"]), "units")
        discard(written)
        written = after
        if after.where("unit <> was").isEmpty():
            discard(held)
            return after.select(query, "chunk_id", "unit")


def jaccards(sets: list, width: int = 1 << 17):
    """Jaccard similarity of each two of a pool's sets of integers, as a matrix; of two empty sets 0. The sets' table of members is multiplied with itself in slices of ``width`` members."""
    import numpy as np

    sizes = np.array([len(s) for s in sets], np.int64)
    members, at = np.unique(np.concatenate([np.asarray(s, np.int64) for s in sets]), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros((len(sets), len(sets)))
    for start in range(0, len(members), width):
        here = (at >= start) & (at < start + width)
        table = np.zeros((len(sets), min(width, len(members) - start)), np.float32)
        table[owner[here], at[here] - start] = 1
        shared += table @ table.T
    united = sizes[:, None] + sizes[None, :] - shared
    return np.where(shared > 0, shared / np.maximum(united, 1), 0.0)


def mmr_select(candidates: DataFrame, k: int, query: str = "query_id", shingle_col: str = "shingles", most_bytes: int | None = None) -> DataFrame:
    """(query, chunk_id, selected): greedy choice of the greatest 0.7 / (rank + 1) - 0.3 * greatest similarity to what is chosen; ties by rank.

    candidates: (query, chunk_id, rank from 0, version, shingles: distinct), and where there are such columns ``signature``
    (ordered protected facts: candidates with other ones are not similar), ``unit`` (candidates of one conflict unit are
    taken together or not at all; null: alone) and ``bytes``. A unit that doesn't fit into k passages or ``most_bytes``
    is left out and the next one is tried. Similarities are made once a pair; each choice then raises every candidate's
    running maximum. A query's pool has at most 120 candidates, and is one row.
    """
    given = {c: F.col(c) if c in candidates.columns else F.lit(None).cast(t) for c, t in (("unit", "string"), ("bytes", "long"), ("signature", "string"))}
    kind = candidates.schema[query].dataType.simpleString()
    alike = F.to_json(F.struct(F.col("version"), given["signature"].alias("signature")))
    whole = candidates.schema[shingle_col].dataType.elementType.typeName() in ("long", "integer")
    hashed = F.col(shingle_col) if whole else F.transform(shingle_col, lambda x: F.xxhash64(x))
    row = F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), given["unit"].cast("string").alias("unit"), F.coalesce(given["bytes"], F.lit(0)).cast("long").alias("bytes"), alike.alias("alike"), hashed.alias("s"))
    pools = candidates.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("c"))

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            out = []
            for q, members in frame.itertuples(index=False, name=None):
                alike = np.unique([m["alike"] for m in members], return_inverse=True)[1]
                similar = np.where(alike[:, None] == alike[None, :], jaccards([m["s"] for m in members]), 0.0)
                units = {}
                for i, m in enumerate(members):
                    units.setdefault(("u", m["unit"]) if m["unit"] is not None else ("i", i), []).append(i)
                unit_of = {i: u for u in units.values() for i in u}
                relevance = np.array([MMR_RELEVANCE / (m["rank"] + 1) for m in members])
                greatest, pending = np.zeros(len(members)), np.ones(len(members), bool)
                taken, used = 0, 0
                while pending.any() and taken < k:
                    score = np.where(pending, np.round(relevance - MMR_REDUNDANCY * greatest, 12), -np.inf)
                    unit = unit_of[int(np.argmax(score))]
                    pending[unit] = False
                    size = sum(members[i]["bytes"] for i in unit)
                    if taken + len(unit) > k or (most_bytes is not None and used + size > most_bytes):
                        continue
                    out.extend((q, members[i]["chunk_id"], taken + n) for n, i in enumerate(unit))
                    taken, used = taken + len(unit), used + size
                    greatest = np.maximum(greatest, similar[unit].max(axis=0))
            yield pd.DataFrame(out, columns=[query, "chunk_id", "selected"])

    ship(candidates.sparkSession)
    return pools.mapInPandas(run, f"`{query}` {kind}, chunk_id string, selected long")


def reading_order(passages: DataFrame, query: str = "query_id") -> DataFrame:
    """Adds ``n`` from 1: passages by their revision's best position, then revision, then span."""
    best = F.min("position").over(Window.partitionBy(query, "revision_id"))
    return passages.withColumn("__b", best).withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("__b", "revision_id", "start", "end"))).drop("__b")


def byte_slice(text: str, start: str, end: str) -> str:
    """SQL: the text between two byte positions; null where these cut a character."""
    return f"try_validate_utf8(decode(substring(encode({text}, 'utf-8'), {start} + 1, {end} - {start}), 'utf-8'))"
