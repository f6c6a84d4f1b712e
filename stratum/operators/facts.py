"""Facts that parsed documents state in tables, and the ordered facts of a passage that must not be merged away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.evidence import is_conditional

# The headers of tables that state facts.
ENTITY_HEADER, DEFAULT_HEADER = ("entity", "attribute", "value"), ("parameter", "default")


def table_facts(tree: DataFrame) -> DataFrame:
    """(document_id, table, row, entity, attribute, value) of the tables of ``block_tree`` that state facts; row counts from 0.

    A table states facts if its header is entity | attribute | value, or parameter | default (then the attribute is
    ``default``), in any case. It states none at all if a row of it lacks a cell, has a blank one, or holds a word of
    condition or negation, as then its rows don't stand alone.
    """
    # Rows hold as many cells as the header at most; a table's rows are children of one node.
    cells = tree.where("kind = 'table_cell'").select("document_id", F.col("parent").alias("node"), F.struct("node", F.trim("text").alias("text")).alias("c"))
    listed = cells.groupBy("document_id", "node").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["text"]).alias("cells"))
    rows = tree.where("kind IN ('table_head', 'table_row')").select("document_id", "node", F.col("parent").alias("table"), "kind").join(listed, ["document_id", "node"])
    header = F.transform("cells", lambda c: F.lower(c))
    shape = F.when(header == F.array(*map(F.lit, ENTITY_HEADER)), 3).when(header == F.array(*map(F.lit, DEFAULT_HEADER)), 2)
    shaped = rows.where("kind = 'table_head'").withColumn("width", shape).where("width IS NOT NULL").select("document_id", "table", "width")
    body = rows.where("kind = 'table_row'").join(shaped, ["document_id", "table"])
    bad = (F.size("cells") != F.col("width")) | F.exists("cells", lambda c: c == "") | F.expr(is_conditional("array_join(cells, ' ')"))
    sound = body.groupBy("document_id", "table").agg(F.max(bad).alias("bad"), F.min("node").alias("first")).where("NOT bad").drop("bad")
    # The rows' places: a row's node less the cells of the rows before it.
    placed = body.join(sound, ["document_id", "table"]).withColumn("row", F.expr("(node - first) div (width + 1)").cast("int"))
    attribute = F.when(F.col("width") == 3, F.col("cells")[1]).otherwise("default")
    return placed.select("document_id", "table", "row", F.col("cells")[0].alias("entity"), attribute.alias("attribute"), F.element_at("cells", -1).alias("value"))


def protected_parts(kind: str = "kind", text: str = "text") -> str:
    """SQL: a block's protected facts in order: words with a number in them, code, and the block itself if it has a condition or negation."""
    numbers = f"transform(filter(split({text}, r'\\s+'), w -> w rlike r'\\p{{N}}'), w -> named_struct('fact', 'number', 'said', w))"
    spans = f"transform(regexp_extract_all({text}, r'`+([^`]+)`+', 1), w -> named_struct('fact', 'code', 'said', w))"
    own = lambda fact, when: f"if({when}, array(named_struct('fact', '{fact}', 'said', {text})), array())"
    return f"concat({own('code', f'{kind} = ' + chr(39) + 'code' + chr(39))}, {own('condition', is_conditional(text))}, {numbers}, {spans})"


def signatures(blocks: DataFrame, key: list[str], order: str = "node") -> DataFrame:
    """(key, signature) of passages given as blocks (key, order, kind, text): equal if and only if their protected facts are, in order.

    A passage's blocks are bounded, as a chunk's are. Passages without such facts share one signature.
    """
    held = blocks.select(*key, F.struct(F.col(order).alias("at"), F.expr(protected_parts()).alias("parts")).alias("p"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["parts"]))
    return held.groupBy(*key).agg(F.sha2(F.to_json(listed), 256).alias("signature"))
