"""Markdown texts as block rows, chrome rules on them, and identities of prepared inputs.

The block parser takes the common shapes (ATX headings, fenced code, lists, tables, quotes, rules,
front matter, paragraphs) line by line; inline markup stays in the block's text. Spans are half-open
UTF-8 byte spans, and every byte of a text belongs to exactly one block or is blank between blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.inventory import has_literal
from stratum.runtime import map_arrow, spread

_KINDS = (
    ("heading", re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)(.*?)(?:[ \t]+#+)?[ \t]*$")),
    ("thematic_break", re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")),
    ("list_item", re.compile(r"[ \t]*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+\S")),
    ("block_quote", re.compile(r" {0,3}>")),
    ("html", re.compile(r" {0,3}<(?:!--|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")),
    ("table_row", re.compile(r"[ \t]*\|.*\|[ \t]*$")),
)
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")


def parse_blocks(text: str) -> list[tuple[str, int, str, int, int]]:
    """(kind, level, text, start, end) of each block; level is a heading's, else 0. Lines end at line feeds and carriage returns only."""
    out: list[list] = []
    at, fence, opened = 0, None, False
    for number, line in enumerate(_LINE.findall(text)):
        size, bare = len(line.encode()), line.rstrip("\r\n")
        start, at = at, at + size

        def extend(shown: str, end: int = at) -> None:
            out[-1][2].append(shown)
            out[-1][4] = end

        if fence is not None:
            extend(bare)
            if bare.strip() == fence or (fence != "---" and re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", bare)):
                fence = None
            opened = fence is not None
            continue
        if number == 0 and bare == "---" and re.search(r"^---[ \t]*$", text[len(line) :], re.M):
            out.append(["metadata", 0, [bare], start, at])
            fence = "---"
            continue
        if not bare.strip():
            opened = False
            continue
        if found := _FENCE.match(bare):
            out.append(["code", 0, [bare], start, at])
            fence = found[1]
            continue
        kind, level, shown = "paragraph", 0, bare.strip()
        for name, pattern in _KINDS:
            if found := pattern.match(bare):
                kind = name
                if name == "heading":
                    level, shown = len(found[1]), found[2].strip()
                break
        if opened and kind == "paragraph" and out[-1][0] in ("paragraph", "list_item", "block_quote", "html"):
            extend(shown)
        elif opened and kind == "block_quote" and out[-1][0] == "block_quote":
            extend(bare)
        else:
            out.append([kind, level, [shown], start, at])
        opened = kind not in ("heading", "thematic_break")
    return [(kind, level, "\n".join(lines), start, end) for kind, level, lines, start, end in out]


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(document_id, position, kind, level, text, start, end) of each document's blocks. Null and empty texts have none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["document_id", "position", "kind", "level", "text", "start", "end"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [(i, p, *b) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p, b in enumerate(parse_blocks(t or ""))]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    chosen = spread(docs.select(F.col(id_col).cast("long").alias("document_id"), F.col(text_col).cast("string").alias("text")))
    return map_arrow(chosen, run, "document_id long, position int, kind string, level int, text string, start long, end long")


def incomplete_tables(parsed: DataFrame) -> DataFrame:
    """(document_id, table, rows): tables of which a row has another number of cells than the first. Neighbouring table rows are one table."""
    from stratum.operators.evidence import consecutive_groups

    grouped = consecutive_groups(parsed, "document_id", "position", "kind").where("kind = 'table_row'")
    cells = grouped.withColumn("cells", F.size(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"(?<!\\)\|")))
    counted = cells.groupBy("document_id", F.col("idea").alias("table")).agg(F.min_by("cells", "position").alias("head"), F.min("cells").alias("a"), F.max("cells").alias("b"), F.count(F.lit(1)).alias("rows"))
    return counted.where("a <> head OR b <> head").select("document_id", "table", "rows")


# Interface labels that an export leaves in a page, and the elements of blocks that are markup only.
HEADING_SUFFIX, PARAGRAPH_SUFFIX, LABEL, LABEL_BEFORE_IMAGE, IMAGE = " Link copied to clipboard", " Copy Copied to clipboard", "Copy Copied to clipboard", "Closed", "<!-- image -->"
MARKUP_ELEMENTS = "a br img div span p hr table thead tbody tfoot tr th td caption colgroup col".split()


def indexed_blocks(parsed: DataFrame) -> DataFrame:
    """Adds ``kept``, the text that is indexed (null: none), and ``rule``: heading_suffix, paragraph_suffix, label, label_before_image, markup, or null where all is kept. The source keeps its bytes."""
    text, kind = F.col("text"), F.col("kind")
    following = F.lead("text").over(Window.partitionBy("document_id").orderBy("position"))
    names = "|".join(MARKUP_ELEMENTS)
    markup = text.rlike(rf"(?is)^\s*(?:(?:<!--.*?-->|</?(?:{names})(?:\s[^<>]*)?/?>)\s*)+$")
    plain = kind.isin("paragraph", "html")
    rule = (
        F.when((kind == "heading") & text.endswith(HEADING_SUFFIX), "heading_suffix").when(plain & (text == LABEL), "label")
        .when(plain & (text == LABEL_BEFORE_IMAGE) & (following == IMAGE), "label_before_image").when(plain & markup, "markup")
        .when((kind == "paragraph") & text.endswith(PARAGRAPH_SUFFIX), "paragraph_suffix")
    )
    cut = lambda suffix: F.expr(f"nullif(rtrim(substring(text, 1, length(text) - {len(suffix)})), '')")
    kept = F.when(F.col("rule") == "heading_suffix", cut(HEADING_SUFFIX)).when(F.col("rule") == "paragraph_suffix", cut(PARAGRAPH_SUFFIX)).when(F.col("rule").isNull(), text)
    return parsed.withColumn("rule", rule).withColumn("kept", kept)


def chrome_counts(indexed: DataFrame) -> DataFrame:
    """(rule, units, bytes) left out of the index."""
    left = F.octet_length("text") - F.coalesce(F.octet_length("kept"), F.lit(0))
    return indexed.where("rule IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("units"), F.sum(left).cast("long").alias("bytes"))


def byte_accounting(parsed: DataFrame, docs: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, bytes, in_blocks, between, valid): every byte of a text is in one block or in the white space between blocks. Texts without blocks have all bytes between."""
    listed = parsed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    raw = docs.select(F.col(id_col).alias("document_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("raw")).join(listed, "document_id", "left")
    edged = raw.withColumn("e", F.expr("concat(array(named_struct('start', 0L, 'end', 0L)), coalesce(s, array()), array(named_struct('start', cast(length(raw) as bigint), 'end', cast(length(raw) as bigint))))"))
    gap = "substring(raw, cast(e[i].end as int) + 1, cast(e[i + 1].start - e[i].end as int))"
    blank = "hex(raw) is not null and trim(BOTH ' \t\r\n\f\u000b\u00a0\u0085\u2028\u2029\u3000' FROM decode(" + gap + ", 'utf-8')) = ''"
    valid = F.expr(f"forall(sequence(0, size(e) - 2), i -> e[i].end <= e[i + 1].start and {blank})")
    inside = F.aggregate("e", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return edged.select("document_id", F.length("raw").cast("long").alias("bytes"), inside.alias("in_blocks"), (F.length("raw") - inside).cast("long").alias("between"), valid.alias("valid"))


def comparison_digest(parsed: DataFrame) -> DataFrame:
    """(document_id, digest) of a document's blocks in order by kind, level and text: spans and ids don't count."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", "kind", "level", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["level"].alias("level"), x["text"].alias("text"))))
    return parsed.groupBy("document_id").agg(F.sha2(body, 256).alias("digest"))


def exact_duplicates(docs: DataFrame, digests: DataFrame, id_col: str = "document_id", text_col: str = "text") -> DataFrame:
    """(document_id, representative): documents are duplicates if both their bytes and their canonical digests agree; the smallest id stands for them."""
    keyed = docs.select(F.col(id_col).alias("document_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("original")).join(digests, "document_id", "left")
    least = keyed.groupBy("original", "digest").agg(F.min("document_id").alias("representative"))
    return keyed.join(least, (keyed["original"] == least["original"]) & keyed["digest"].eqNullSafe(least["digest"])).select("document_id", "representative")


def chunk_documents(parsed: DataFrame, packing: str = "section", close_at: int = 500, most: int = 700, small: int | None = 150) -> DataFrame:
    """(document_id, section, chunk, first, last, tokens, context) of blocks (document_id, position, kind, level, start, text).

    Sections begin at headings; 0 is what comes before the first. A heading is context: its path, joined by `` > ``, goes with
    every chunk of its section. packing ``section``: all blocks of a section may share a chunk; ``container``: only neighbours of
    one kind. A block of over ``most`` words is cut after white space. small: chunks under it join the one before; None: they stay.
    first and last are positions, chunk counts from 0 in a section. Blocks without a document_id are those of one more document.
    """
    from stratum.operators.assembly import rerank_windows
    from stratum.operators.evidence import consecutive_groups, greedy_pack, heading_paths

    w = Window.partitionBy("document_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = parsed.withColumn("section", F.count_if(F.col("kind") == "heading").over(w))
    if packing == "container":
        placed = consecutive_groups(placed, "document_id", "position", "kind")
    else:
        placed = placed.withColumn("idea", F.lit(0))
    headings = placed.where("kind = 'heading'").select("document_id", "section", "start", "level", F.col("text").alias("title"))
    paths = heading_paths(headings).select("document_id", "section", F.array_join("heading_path", " > ").alias("context"))
    units = rerank_windows(placed.where("kind <> 'heading'"), ["document_id", "section", "idea", "position"], "text", most)
    sized = units.withColumn("tokens", F.expr("size(filter(split(text, r'\\s+'), x -> x <> ''))"))
    keyed = sized.withColumns({"key": F.struct("document_id", "section", "idea"), "at": F.shiftleft(F.col("position").cast("long"), 31) + F.col("window")})
    packed = greedy_pack(keyed, "key", "at", "tokens", close_at, most, small or 0)
    chunks = packed.select("key.*", "chunk", F.shiftright("first", 31).alias("first"), F.shiftright("last", 31).alias("last"), "tokens")
    numbered = chunks.withColumn("chunk", F.row_number().over(Window.partitionBy("document_id", "section").orderBy("idea", "chunk")).cast("long") - 1)
    named = paths.withColumnsRenamed({"document_id": "__d", "section": "__s"})
    same = F.col("document_id").eqNullSafe(F.col("__d")) & (F.col("section") == F.col("__s"))
    return numbered.join(named, same, "left").select("document_id", "section", "chunk", "first", "last", "tokens", F.coalesce("context", F.lit("")).alias("context"))


def finding_rollup(findings: DataFrame, key: str) -> DataFrame:
    """(key, code, message): equal findings of a revision once, with how often."""
    counted = findings.groupBy(key, "code", "message").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, "code", F.when(F.col("n") > 1, F.concat("message", F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))).otherwise(F.col("message")).alias("message"))


def prepared_groups(inputs: DataFrame, text: str = "text", chunk: str = "chunk_id") -> DataFrame:
    """(digest, chunk_id, members): equal prepared inputs share one identity, the smallest chunk's."""
    return inputs.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(chunk).alias("chunk_id"), F.count(F.lit(1)).alias("members"))


def chunk_set_identity(revisions: DataFrame, by: list[str], profile: str, counter: str) -> DataFrame:
    """(by, chunk_set): the hash of collection, profile, counter and sorted revision ids."""
    body = F.to_json(F.struct(*by, F.lit(profile).alias("profile"), F.lit(counter).alias("counter"), F.array_sort(F.collect_list("revision_id")).alias("revisions")))
    return revisions.groupBy(*by).agg(F.sha2(body, 256).alias("chunk_set"))


def point_id(name: str, namespace: str) -> str:
    """SQL: the name-based UUID (version 5) of a text in a namespace UUID."""
    raw = f"sha1(concat(unhex('{namespace.replace('-', '')}'), encode({name}, 'utf-8')))"
    variant = f"substr('89ab', cast(conv(substr({raw}, 17, 1), 16, 10) as int) % 4 + 1, 1)"
    return f"concat(substr({raw}, 1, 8), '-', substr({raw}, 9, 4), '-5', substr({raw}, 14, 3), '-', {variant}, substr({raw}, 18, 3), '-', substr({raw}, 21, 12))"


def arbitrate(candidates: DataFrame, key: str = "id") -> DataFrame:
    """(key, family, start, end, value) of the identifiers that stand: by priority, then start, each that overlaps none taken before. Only stretches of overlapping candidates are folded, whatever a text's length."""
    place = Window.partitionBy(key).orderBy("start", "end")
    apart = F.col("start") >= F.coalesce(F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    candidates = candidates.withColumn("__apart", apart).withColumn("__stretch", F.count_if("__apart").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    item = "struct<priority:int,start:bigint,end:bigint,family:string,value:string>"
    listed = candidates.groupBy(key, "__stretch").agg(F.array_sort(F.collect_list(F.struct(F.col("priority").cast("int").alias("priority"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "family", "value"))).alias("c"))
    fold = f"aggregate(c, cast(array() as array<{item}>), (s, x) -> if(exists(s, y -> x.start < y.end AND y.start < x.end), s, concat(s, array(x))))"
    return listed.select(key, F.explode(F.expr(fold)).alias("x")).select(key, "x.family", "x.start", "x.end", "x.value")


def supported(answers: DataFrame, passages: DataFrame, answer: str = "answer") -> DataFrame:
    """(question_id, supported, reason): citations name passages there are, three words or more, and every number, version, flag, path or back-quoted command of the answer stands by itself in the question or a passage."""
    held = passages.groupBy("question_id").agg(F.collect_set("n").alias("ns"), F.concat_ws("\n", F.collect_list("text")).alias("evidence"))
    out = answers.join(held, "question_id", "left")
    cited = F.expr(f"flatten(transform(regexp_extract_all({answer}, r'\\[([0-9]+(?:, ?[0-9]+)*)\\]', 1), c -> transform(split(c, ', ?'), x -> cast(x as int))))")
    plain = F.regexp_replace(answer, r"\[[0-9]+(?:, ?[0-9]+)*\]", " ")
    literals = F.expr("concat(regexp_extract_all(__plain, r'(--?[A-Za-z][A-Za-z0-9-]*|v?[0-9]+(?:\\.[0-9]+)*)', 1), regexp_extract_all(__plain, r'`([^`\\n]+)`', 1), regexp_extract_all(__plain, r'(?:^|\\s)((?:~|\\.{1,2})?/[^\\s,;!?)]*[^\\s,;!?).])', 1))")
    words = F.expr("size(regexp_extract_all(__plain, r'\\p{L}+', 0))")
    checked = out.withColumn("__plain", plain).withColumns({"__cited": cited, "__literals": literals, "__words": words})
    source = F.concat_ws("\n", F.col("question"), F.col("evidence"))
    reason = (
        F.when(F.size("__cited") == 0, "no citation").when(~F.forall("__cited", lambda n: F.coalesce(F.array_contains("ns", n), F.lit(False))), "a citation of no passage")
        .when(F.col("__words") < 3, "too short").when(F.exists("__literals", lambda x: ~has_literal(source, x)), "a literal without support")
    )
    return checked.select("question_id", reason.isNull().alias("supported"), reason.alias("reason"))
