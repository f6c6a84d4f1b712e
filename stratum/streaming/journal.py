"""Append-only event journal, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.operators.numbering import numbered

#: Allowed steps of a job and of a generation.
JOB_STEPS = {("queued", "running"), ("running", "succeeded"), ("running", "failed"), ("queued", "cancelled"), ("running", "cancelled"), ("running", "queued")}
GENERATION_STEPS = {("building", "verified"), ("verified", "published"), ("published", "retired"), ("building", "failed"), ("verified", "failed"), ("retired", "published")}


def sequenced(events: DataFrame, stream: str, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Adds ``sequence``: gap-free from 1 in each stream, or from after ``start`` (stream, last). A stream of any length is numbered in ranges."""
    held = numbered(events, order, "sequence", by=stream).withColumn("sequence", F.col("sequence").cast("long") + 1)
    if start is None:
        return held
    return held.join(start.select(stream, "last"), stream, "left").withColumn("sequence", F.col("sequence") + F.coalesce("last", F.lit(0))).drop("last")


def last_sequences(journal: DataFrame, stream: str) -> DataFrame:
    return journal.groupBy(stream).agg(F.max("sequence").alias("last"))


def read_after(journal: DataFrame, cursors: DataFrame, stream: str, kind: str | None = None, kind_column: str = "type") -> DataFrame:
    """Events after each (consumer, stream)'s position, with the consumer; a stream without a cursor is read by no one."""
    out = journal.join(cursors, stream).where(F.col("sequence") > F.col("position"))
    return out if kind is None else out.where(F.col(kind_column) == kind)


def acknowledge(cursors: DataFrame, acks: DataFrame, journal: DataFrame, stream: str) -> DataFrame:
    """Cursors moved forward to the largest acknowledged position within the stream: never back and never past its end."""
    asked = acks.groupBy("consumer", stream).agg(F.max("position").alias("asked"))
    ends = last_sequences(journal, stream)
    joined = cursors.join(asked, ["consumer", stream], "full").join(ends, stream, "left")
    held, last = F.coalesce("position", F.lit(0)), F.coalesce("last", F.lit(0))
    moved = F.when(F.col("asked").isNull() | (F.col("asked") > last) | (F.col("asked") < held), held).otherwise(F.col("asked"))
    return joined.select("consumer", stream, moved.cast("long").alias("position"))


def cursor_lag(journal: DataFrame, cursors: DataFrame, stream: str) -> DataFrame:
    ends = last_sequences(journal, stream)
    return cursors.join(ends, stream, "left").select("consumer", stream, (F.coalesce("last", F.lit(0)) - F.col("position")).alias("lag"))


def fold_states(events: DataFrame, key: str, order: str, state: str, first: str, steps: set[tuple[str, str]], block: int = 4096) -> DataFrame:
    """(key, state, version, refused): state after applying each event in order where the step is allowed.

    A key's events are folded in blocks of ``block``, each from every state it may start in, and then the blocks'
    results in order, so no row holds a long history.
    """
    allowed = ", ".join(f"'{a}>{b}'" for a, b in sorted(steps))
    states = ", ".join(f"'{x}'" for x in sorted({x for step in steps for x in step} | {first}))
    kind = "struct<state:string,version:bigint,refused:bigint>"
    numbered = events.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order, state)))
    listed = numbered.groupBy(key, F.floor((F.col("__n") - 1) / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(state).alias("state")))).alias("e"))
    fold = f"""aggregate(e, cast(struct(start as state, 0L as version, 0L as refused) as {kind}), (s, x) ->
        if(concat(s.state, '>', x.state) IN ({allowed}), struct(x.state as state, s.version + 1 as version, s.refused as refused), struct(s.state as state, s.version as version, s.refused + 1 as refused)))"""
    blocks = listed.select(key, "block", F.expr(f"transform(array({states}), start -> struct(start, {fold} as end))").alias("ends"))
    whole = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("b"))
    join = f"""aggregate(b, cast(struct('{first}' as state, 0L as version, 0L as refused) as {kind}), (s, x) -> transform(filter(x.ends, y -> y.start = s.state),
        y -> struct(y.end.state as state, s.version + y.end.version as version, s.refused + y.end.refused as refused))[0])"""
    return whole.select(key, F.expr(join).alias("s")).select(key, "s.state", "s.version", "s.refused")


def lease_fold(requests: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, state, number, holder, expires, takeovers, refused) after each job's requests (at, seq, op, holder, number, term) in order.

    take: granted to a queued job, or a running one whose lease has run out at that time (a take-over); the fencing number grows by
    one. heartbeat: the lease's own holder and number renew it, run out or not, until another takes over. succeed, fail and cancel
    need the same, and end the lease. Anything else is refused. A job's requests are few and are folded in one row.
    """
    listed = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), "op", "holder", F.col("number").cast("long").alias("number"), F.col("term").cast("long").alias("term")))).alias("e"))
    kind = "struct<state:string,number:bigint,holder:string,expires:bigint,takeovers:bigint,refused:bigint>"
    make = lambda *v: f"cast(struct({', '.join(v)}) as {kind})"
    own = "(s.state = 'running' and s.holder <=> x.holder and s.number = x.number)"
    fold = f"""aggregate(e, {make("'queued'", "0L", "cast(null as string)", "0L", "0L", "0L")}, (s, x) -> CASE
        WHEN x.op = 'take' and s.state = 'queued' THEN {make("'running'", "s.number + 1", "x.holder", "x.at + x.term", "s.takeovers", "s.refused")}
        WHEN x.op = 'take' and s.state = 'running' and s.expires <= x.at THEN {make("'running'", "s.number + 1", "x.holder", "x.at + x.term", "s.takeovers + 1", "s.refused")}
        WHEN x.op = 'heartbeat' and {own} THEN {make("s.state", "s.number", "s.holder", "x.at + x.term", "s.takeovers", "s.refused")}
        WHEN x.op in ('succeed', 'fail', 'cancel') and {own} THEN {make("CASE x.op WHEN 'succeed' THEN 'succeeded' WHEN 'fail' THEN 'failed' ELSE 'cancelled' END", "s.number", "cast(null as string)", "0L", "s.takeovers", "s.refused")}
        ELSE {make("s.state", "s.number", "s.holder", "s.expires", "s.takeovers", "s.refused + 1")} END)"""
    return listed.select(key, F.expr(fold).alias("s")).select(key, "s.*")


def publish_if_current(generations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generations (generation_id, collection_id, state) after the requests (generation_id, expected), and each request's ``outcome``.

    One request a collection is looked at, the one with the smallest generation. published: it was verified and ``expected`` is the
    collection's published generation, or null as there is none; that one is retired. Else unknown, illegal, changed or later.
    """
    live = generations.where("state = 'published'").select("collection_id", F.col("generation_id").alias("current"))
    asked = requests.join(generations, "generation_id", "left").join(live, "collection_id", "left")
    turn = F.row_number().over(Window.partitionBy("collection_id").orderBy("generation_id"))
    outcome = F.when(F.col("state").isNull(), "unknown").when(turn > 1, "later").when(F.col("state") != "verified", "illegal").when(~F.col("expected").eqNullSafe(F.col("current")), "changed").otherwise("published")
    judged = asked.select("generation_id", "collection_id", outcome.alias("outcome"))
    done = judged.where("outcome = 'published'").select("collection_id", F.col("generation_id").alias("__new"))
    state = F.when(F.col("generation_id") == F.col("__new"), "published").when(F.col("__new").isNotNull() & (F.col("state") == "published"), "retired").otherwise(F.col("state"))
    after = generations.join(done, "collection_id", "left").select("generation_id", "collection_id", state.alias("state"))
    return after, judged.select("generation_id", "outcome")


#: Public events and the fields of their data.
PUBLIC_EVENTS = {
    "import.completed": ("collection", "imported", "unchanged", "held", "refused"),
    "revision.held": ("collection", "revision", "disposition"),
    "generation.published": ("collection", "generation", "points"),
    "generation.retired": ("collection", "generation"),
}


def public_events(rows: DataFrame, kind: str) -> DataFrame:
    """(stream, type, data) of one kind: rows have the kind's fields, and data is their JSON in that order."""
    fields = PUBLIC_EVENTS[kind]
    return rows.select(F.concat(F.lit("collection/"), "collection").alias("stream"), F.lit(f"{kind}.v1").alias("type"), F.to_json(F.struct(*fields)).alias("data"))


def envelopes(journal: DataFrame, stream: str, kind: str, data: str) -> DataFrame:
    """(id, envelope): events as JSON envelopes with version, id, source, type, sequence and data."""
    body = F.to_json(F.struct(F.lit("1.0").alias("specversion"), F.concat(F.col(stream).cast("string"), F.lit("/"), F.col("sequence").cast("string")).alias("id"), F.col(stream).cast("string").alias("source"), F.col(kind).alias("type"), F.col("sequence"), F.col(data).alias("data")))
    return journal.select(F.concat(F.col(stream).cast("string"), F.lit("/"), F.col("sequence").cast("string")).alias("id"), body.alias("envelope"))


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which asks for an instant; a batch as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event-time window and type, for batch or stream; with a watermark on a stream."""
    held = _timed(events, time, late)
    return held.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(value), 4).alias("total")).select(F.col("window.start").alias("window_start"), kind, "events", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    held = _timed(events, time, late)
    return held.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def drain(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return the table it has written: a restart goes on from the checkpoint and writes nothing twice."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
