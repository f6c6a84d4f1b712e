"""Corpus manifests and the files they name; immutable revisions and content-addressed artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.runtime import settle

ENTRY = "path string, sha256 string, bytes long, source_ref string, title string, source_kind string, `set` string, version string, lang string, captured_at string, product string, component string, platform string, extractor map<string,string>, access map<string,string>"
REQUIRED = ("path", "sha256", "bytes", "source_ref", "title", "source_kind")
FIELDS = ("schema", *REQUIRED, "set", "version", "lang", "captured_at", "product", "component", "platform", "extractor", "access")


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries and refusals (line, reason) of a JSON-lines manifest. Lines are strict: an object, no unknown field, all required ones there, sizes and hashes well formed. Blank lines count but are neither."""
    lines = _numbered_lines(spark, path).where(F.trim("raw") != "")
    parsed = lines.withColumn("e", F.from_json("raw", ENTRY)).withColumn("keys", F.json_object_keys("raw"))
    known = F.array(*map(F.lit, FIELDS))
    missing = F.filter(F.array(*[F.when(F.col(f"e.{f}").isNull(), F.lit(f)) for f in REQUIRED]), lambda x: x.isNotNull())
    reason = (
        F.when(F.col("keys").isNull(), "not an object")
        .when(F.size(F.array_distinct("keys")) < F.size("keys"), "a field twice")
        .when(F.size(F.array_except("keys", known)) > 0, "an unknown field")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(~F.col("e.sha256").rlike("^[0-9a-f]{64}$"), "not a SHA-256")
        .when(F.col("e.bytes") < 0, "a negative size")
    )
    checked = parsed.withColumn("reason", reason)
    return checked.where("reason IS NULL").select("line", "e.*"), checked.where("reason IS NOT NULL").select("line", "reason")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, raw): lines with their numbers in the file, from 1. A file is read in its splits: lines are numbered in each, and the few splits' counts give where each begins."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))
    held = settle(read, "lines")
    sizes = held.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return held.withColumn("within", within).join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("within")).alias("line"), "raw")


def verified(entries: DataFrame, root: str) -> DataFrame:
    """Entries with their files' ``content`` and ``state``: imported, missing, size, digest or encoding. Files are read where they lie, by Spark."""
    spark = entries.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.expr(f"regexp_replace(path, '^[a-z]+:/*', '/')").alias("__p"), F.col("content"))
    place = F.concat(F.lit("/" + root.split(":", 1)[-1].strip("/") + "/"), F.col("path"))
    joined = entries.withColumn("__p", place).join(files, "__p", "left").drop("__p")
    state = (
        F.when(F.col("content").isNull(), "missing").when(F.length("content") != F.col("bytes"), "size").when(F.sha2("content", 256) != F.col("sha256"), "digest")
        .when(F.expr("try_validate_utf8(cast(content as string))").isNull(), "encoding").otherwise("imported")
    )
    return joined.withColumn("state", state)


def shared_references(entries: DataFrame, reference: str = "source_ref", digest: str = "sha256") -> DataFrame:
    """References that stand for two or more contents: all their revisions are to be held."""
    return entries.groupBy(reference).agg(F.countDistinct(digest).alias("digests")).where("digests > 1")


def revision_changes(held: DataFrame, incoming: DataFrame, key: str = "revision_id", content: str = "content_hash") -> DataFrame:
    """Each incoming row's ``change``: new, unchanged, or conflict where the id is held with other content."""
    old = held.select(key, F.col(content).alias("__old"))
    return incoming.join(old, key, "left").withColumn("change", F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col(content), "unchanged").otherwise("conflict")).drop("__old")


def upsert(held: DataFrame, incoming: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows of both by key: incoming ones replace held ones, or are ignored."""
    if replace:
        return held.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)
    return held.unionByName(incoming.join(held.select(*keys), keys, "left_anti"))


def put_artifacts(contents: DataFrame, column: str = "content") -> DataFrame:
    """(digest, content, bytes), once for each content."""
    return contents.groupBy(F.sha2(column, 256).alias("digest")).agg(F.first(column).alias("content")).withColumn("bytes", F.length("content").cast("long"))


def collectable(artifacts: DataFrame, pins: DataFrame) -> DataFrame:
    """Artifacts that no pin holds."""
    return artifacts.join(pins.where("pins > 0"), "digest", "left_anti")


def write_points(points: DataFrame, path: str, generation: str) -> None:
    """A generation's points as its own partition folder, clustered by point id. Writing it again replaces it and no other, so an interrupted write is simply repeated; of points with one id the first by all columns stays."""
    one = points.groupBy("point_id").agg(F.min(F.struct(*[c for c in points.columns if c != "point_id"])).alias("p")).select("point_id", "p.*") if len(points.columns) > 1 else points.distinct()
    one.withColumn("generation", F.lit(generation)).sortWithinPartitions("point_id").write.partitionBy("generation").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def verify_generation(points: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) of chunks without a point, to be empty before a generation is published."""
    return chunks.select("chunk_id").join(points.select(F.col("point_id").alias("chunk_id")), "chunk_id", "left_anti")


def union_scopes(*parts: DataFrame) -> DataFrame:
    """All known scopes, repeats kept."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
