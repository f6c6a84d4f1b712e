"""Sharding on a consistent-hash ring with virtual nodes and bounded loads. DataFrame functions only.

The ring has ``CELLS`` places. Each shard owns ``VNODES`` of them; a row's place is the hash of its
key, and the arc it lies in belongs to the next virtual node clockwise. A shard takes rows up to its
capacity; what overflows goes on clockwise to the next shard that has room. With ``slack`` 0 the
capacities add up to the number of rows, so counts are at most one apart (law ``rows``).

What is decided for whole arcs is decided from counts: at most CELLS counts, whatever the input. Arcs
fill in rounds: first every arc's own shard in arc order, then each arc's second shard, and so on. A
row's rank in its arc (place, then key) says to which of the arc's shards it goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.runtime import settle
from stratum.sources.tables import table

CELLS = 1 << 16
VNODES = 64
SHARDS = 8


def _cell_of(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 4), 16, 10) as int)"


def _ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(arc, upto, prefs): each arc's last cell and all shards in the order met clockwise from it. At most shards * vnodes rows."""
    nodes = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    placed = nodes.select("shard", F.expr(_cell_of("concat('node ', shard, ' ', v)")).alias("upto")).groupBy("upto").agg(F.min("shard").alias("shard"))
    one = placed.agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("nodes"))
    # A shard whose places were all taken by smaller ones still takes part: it comes last in every order.
    everyone = F.sequence(F.lit(0), F.lit(shards - 1))
    return one.select("nodes", F.posexplode("nodes").alias("arc", "node")).select(
        "arc",
        F.col("node.upto").alias("upto"),
        F.array_distinct(F.concat(F.expr("slice(nodes.shard, arc + 1, size(nodes))"), F.expr("slice(nodes.shard, 1, greatest(arc, 1))"), everyone)).alias("prefs"),
    )


def _cells(ring: DataFrame) -> DataFrame:
    """(cell, arc) of all CELLS cells: cells after the last virtual node belong to the first arc."""
    w = Window.orderBy("arc")
    spans = ring.select("arc", "upto", F.lag("upto", 1, -1).over(w).alias("after"), F.max("upto").over(Window.partitionBy()).alias("last"))
    inside = spans.select("arc", F.explode(F.sequence(F.col("after") + 1, F.col("upto"))).alias("cell"))
    wrapped = spans.where("arc = 0").where(F.col("last") < CELLS - 1).select("arc", F.explode(F.sequence(F.col("last") + 1, F.lit(CELLS - 1))).alias("cell"))
    return inside.unionByName(wrapped).select("cell", "arc")


def _takes(arcs: DataFrame, shards: int, slack: float) -> DataFrame:
    """(arc, begin, upto, shard, offset): which ranks of each arc go to which shard, and the slot of the first.

    A round for each place in the arcs' orders, of windows over at most one row an arc; it ends as soon as all rows are taken.
    """
    total = arcs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    share = F.ceil(F.col("total") * F.lit(1 + slack) / shards) if slack else F.floor(F.col("total") / shards) + F.when(F.col("shard") < F.col("total") % shards, 1).otherwise(0)
    room = arcs.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).crossJoin(total).select("shard", share.cast("long").alias("room"))
    rest, given = arcs.select("arc", F.col("n").alias("rest"), "prefs"), None
    for choice in range(shards):
        before = F.sum("rest").over(Window.partitionBy("shard").orderBy("arc")) - F.col("rest")
        asked = rest.withColumn("shard", F.col("prefs")[choice]).join(F.broadcast(room), "shard")
        taken = settle(asked.withColumn("take", F.least("rest", F.greatest(F.col("room") - before, F.lit(0).cast("long")))), "round")
        part = taken.where("take > 0").select(F.lit(choice).alias("choice"), "arc", "shard", "take")
        given = part if given is None else given.unionByName(part)
        rest = taken.where("take < rest").select("arc", (F.col("rest") - F.col("take")).alias("rest"), "prefs")
        if rest.isEmpty():
            break
        used = taken.groupBy("shard").agg(F.sum("take").alias("used"))
        room = settle(room.join(used, "shard", "left").select("shard", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")), "room")
    in_arc, in_shard = Window.partitionBy("arc").orderBy("choice"), Window.partitionBy("shard").orderBy("choice", "arc")
    return given.select("arc", "shard", F.sum("take").over(in_arc).alias("upto"), "take", (F.sum("take").over(in_shard) - F.col("take")).alias("offset")).select(
        "arc", (F.col("upto") - F.col("take")).alias("begin"), "upto", "shard", "offset"
    )


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, vnodes: int = VNODES, slack: float = 0.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text plus 1, null text: 1; its CRC-32 is that of no bytes. Null ids are
    placed like the key ''. Rows that are equal in id, size and CRC-32 are counted before they are
    shuffled and get slots one after the other. slot counts from 0 in each shard without gaps.
    No rows give no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    if shards * vnodes > 4096:
        raise ValueError("at most 4096 virtual nodes, as the ring's tables are broadcast")
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keyed = keyed.withColumn("cell", F.expr(_cell_of("coalesce(cast(doc_id as string), '')")))
    rows = settle(keyed.groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("m")), "keyed")
    ring = settle(_ring(spark, shards, vnodes), "ring")
    counts = rows.groupBy("cell").agg(F.sum("m").alias("n")).join(F.broadcast(_cells(ring)), "cell")
    cells = settle(counts.withColumn("before", F.sum("n").over(Window.partitionBy("arc").orderBy("cell")) - F.col("n")), "cells")
    arcs = settle(cells.groupBy("arc").agg(F.sum("n").alias("n")).join(F.broadcast(ring.select("arc", "prefs")), "arc"), "arcs")
    takes = settle(_takes(arcs, shards, slack), "takes")
    order = Window.partitionBy("cell").orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "size", "text_crc32", "doc_id")
    ranked = rows.withColumn("upto", F.sum("m").over(order)).join(F.broadcast(cells.select("cell", "arc", "before")), "cell")
    # Equal rows come back in two steps, so no array is longer than the square root of what it stands for asks.
    chunked = ranked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / 4096))).alias("chunk"))
    single = chunked.select(
        "arc", "doc_id", "size", "text_crc32",
        F.explode(F.sequence(F.col("chunk") * 4096, F.least(F.col("m"), (F.col("chunk") + 1) * 4096) - 1)).alias("copy"),
        (F.col("before") + F.col("upto") - F.col("m")).alias("first"),
    ).withColumn("rank", F.col("first") + F.col("copy"))
    placed = single.join(F.broadcast(takes.withColumnRenamed("upto", "end")), "arc").where("rank >= begin AND rank < end")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("rank") - F.col("begin")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _oracle(shards: int = SHARDS, vnodes: int = VNODES) -> str:
    """The same in DuckDB, the rounds as one table each."""
    cell = "CAST(('0x' || substr(md5({}), 1, 4)) AS INTEGER)"
    rounds = []
    for r in range(shards):
        rounds.append(
            f"""u{r} AS (SELECT *, least(rest, greatest(0, quota - used - (sum(rest) OVER (PARTITION BY shard ORDER BY arc) - rest))) AS t
               FROM (SELECT p.arc, p.shard, a{r}.rest, q.quota, q.used FROM prefs p JOIN a{r} ON p.arc = a{r}.arc JOIN q{r} q ON p.shard = q.shard WHERE p.choice = {r})),
            a{r + 1} AS (SELECT arc, rest - t AS rest FROM u{r}),
            q{r + 1} AS (SELECT q.shard, q.quota, q.used + coalesce(x.t, 0) AS used FROM q{r} q LEFT JOIN (SELECT shard, sum(t) AS t FROM u{r} GROUP BY shard) x ON q.shard = x.shard)"""
        )
    takes = " UNION ALL ".join(f"SELECT {r} AS choice, arc, shard, t FROM u{r} WHERE t > 0" for r in range(shards))
    return f"""
WITH nodes AS (SELECT upto, min(shard) AS shard FROM (SELECT i % {shards} AS shard, {cell.format(f"'node ' || (i % {shards}) || ' ' || (i // {shards})")} AS upto FROM range({shards * vnodes}) r(i)) GROUP BY upto),
ring AS (SELECT row_number() OVER (ORDER BY upto) - 1 AS arc, upto, shard FROM nodes),
size_ AS (SELECT count(*) AS n FROM ring),
met AS (SELECT a.arc, b.shard, min((b.arc - a.arc + n) % n) AS gap FROM ring a, ring b, size_ GROUP BY a.arc, b.shard),
prefs AS (SELECT arc, shard, row_number() OVER (PARTITION BY arc ORDER BY gap) - 1 AS choice FROM met),
docs AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h, {cell.format("coalesce(CAST(doc_id AS VARCHAR), '')")} AS cell FROM documents),
placed AS (SELECT d.*, coalesce(r.arc, 0) AS arc FROM docs d ASOF LEFT JOIN ring r ON d.cell <= r.upto),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY cell, h, size, doc_id) - 1 AS rank FROM placed),
a0 AS (SELECT arc, count(*) AS rest FROM ranked GROUP BY arc),
q0 AS (SELECT CAST(s AS BIGINT) AS shard, n // {shards} + CASE WHEN s < n % {shards} THEN 1 ELSE 0 END AS quota, 0 AS used FROM range({shards}) r(s), (SELECT count(*) AS n FROM docs)),
{", ".join(rounds)},
takes AS (SELECT arc, shard, sum(t) OVER (PARTITION BY arc ORDER BY choice) AS upto, t, sum(t) OVER (PARTITION BY shard ORDER BY choice, arc) - t AS "offset" FROM ({takes}))
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, 'rows' AS law, CAST(t.shard AS INTEGER) AS shard, CAST(t."offset" + r.rank - (t.upto - t.t) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked r JOIN takes t ON r.arc = t.arc AND r.rank >= t.upto - t.t AND r.rank < t.upto
"""


def op3_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
