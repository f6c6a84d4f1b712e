"""Rule-based quality dispositions of plain text and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import text as T

#: Outcomes by severity.
OUTCOMES = ("accepted", "accepted_with_warnings", "needs_reextraction", "quarantined", "excluded")
# Whole texts of error messages, prompts, and openings of prompts.
APPLICATION_ERRORS = """something went wrong
something went wrong please try again later
oops something went wrong
oops something went wrong please try again later
an error occurred
an error has occurred
an unexpected error occurred
an unexpected error has occurred
internal server error
500 internal server error
service unavailable
503 service unavailable
bad gateway
502 bad gateway
page not found
404 not found
404 page not found
sorry to interrupt
css error""".split("\n")
PROMPTS = ("sign in", "sign on", "log in", "login", "access denied", "just a moment", "attention required", "authentication required")
PROMPT_OPENINGS = (
    "sign in to continue", "log in to continue", "please sign in", "please log in", "you must be signed in",
    "checking your browser", "verify you are human", "please enable javascript", "enable javascript and cookies",
)
NEAR_EMPTY_WORDS, PAGE_WORDS, NAVIGATION_LINKS, NAVIGATION_PERCENT, REPLACEMENT_PERCENT = 8, 50, 10, 90, 1
#: Our own patterns: private key block, cloud access key, code hosts' and chat tokens.
SECRETS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----|(^|[^A-Za-z0-9])(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,})"


def _listed(x: str, values: tuple[str, ...] | list[str]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def rule_tests(text: str = "text", d: T.Dialect = T.SPARK) -> dict[str, tuple[str, str]]:
    """Each text rule's outcome and condition, in rule order. The first line stands for the first heading or paragraph."""
    words = T.word_count(text, d)
    marks = f"(length({text}) - length(replace({text}, '�', '')))"
    first = T.prompt_form(f"split_part({text}, {'chr(10)'}, 1)", d)
    opening = " OR ".join(f"({first} = '{p}' OR {first} LIKE '{p} %')" for p in PROMPT_OPENINGS)
    return {
        "body.near-empty": ("needs_reextraction", f"{words} < {NEAR_EMPTY_WORDS}"),
        "text.replacement-characters": ("accepted_with_warnings", f"{marks} > 0 AND {marks} * 100 < length({text}) * {REPLACEMENT_PERCENT}"),
        "text.replacement-heavy": ("needs_reextraction", f"{marks} > 0 AND {marks} * 100 >= length({text}) * {REPLACEMENT_PERCENT}"),
        "text.extraction-artifacts": ("needs_reextraction", f"{text} LIKE '%DOCLINGCODE%' OR {text} LIKE '%DOCLINGBREAK%'"),
        "text.suspected-secret": ("quarantined", d.matches(text, SECRETS)),
        "page.application-error": ("needs_reextraction", _listed(first, APPLICATION_ERRORS)),
        "page.sign-in": ("needs_reextraction", f"{words} < {PAGE_WORDS} AND ({_listed(first, PROMPTS)} OR {opening})"),
    }


def flags(docs: DataFrame, text_col: str = "text", extra: list[Column] | None = None) -> DataFrame:
    """``docs`` with ``flags``: array of (severity, position, rule, outcome) of the rules that hold. Null text counts as empty."""
    prepared = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    found = [
        F.when(F.expr(test), F.struct(F.lit(OUTCOMES.index(outcome)).alias("severity"), F.lit(10 * k).alias("position"), F.lit(rule).alias("rule"), F.lit(outcome).alias("outcome")))
        for k, (rule, (outcome, test)) in enumerate(rule_tests("__text").items())
    ]
    every = F.array(*found, *(extra or []))
    return prepared.withColumn("flags", F.filter(every, lambda x: x.isNotNull())).drop("__text")


def record_flags(failed: Column, source_ref: Column, title: Column, incomplete_tables: Column, missing_assets: Column) -> list[Column]:
    """Flags of what is recorded about a document, for ``flags``' extra: a failed canonicalization, tables with incomplete rows, a blank source reference or title, assets that are missing or outside the root."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = (
        ("canonicalization.failed", "needs_reextraction", -10, failed), ("table.incomplete", "accepted_with_warnings", 45, incomplete_tables > 0),
        ("metadata.missing", "quarantined", 100, blank(source_ref) | blank(title)), ("assets.missing", "accepted_with_warnings", 110, missing_assets > 0),
    )
    return [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(OUTCOMES.index(o)).alias("severity"), F.lit(p).alias("position"), F.lit(rule).alias("rule"), F.lit(o).alias("outcome"))) for rule, o, p, test in found]


def gate_report(decided: DataFrame, ledger_outcome: str | None = None) -> DataFrame:
    """(kind, name, revisions): revisions by outcome, each counted once; by rule; by who decided; and kept ones whose ledger rule says something else."""
    one = lambda kind, rows, name: rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("revisions")).select(F.lit(kind).alias("kind"), "name", "revisions")
    out = one("outcome", decided, F.col("outcome")).unionByName(one("rule", decided.select(F.explode("rules").alias("r")), F.col("r"))).unionByName(one("decided_by", decided, F.col("decided_by")))
    if ledger_outcome is None:
        return out
    outranked = decided.where((F.col("decided_by") == "kept") & F.col(ledger_outcome).isNotNull() & (F.col(ledger_outcome) != F.col("outcome")))
    return out.unionByName(one("outranked", outranked, F.col(ledger_outcome)))


def decide(flagged: DataFrame, kept: str | None = None, ledger: str | None = None, failed: str | None = None) -> DataFrame:
    """Adds ``outcome``, ``rules`` and ``decided_by``: a kept disposition, else the ledger's first rule unless it would accept a failed document, else the most severe flag.

    Rules come most severe first, then in rule order.
    """
    ordered = F.transform(F.array_sort(F.transform("flags", lambda x: F.struct((-x["severity"]).alias("s"), x["position"].alias("p"), x["rule"].alias("rule"), x["outcome"].alias("outcome")))), lambda x: F.struct(x["rule"].alias("rule"), x["outcome"].alias("outcome")))
    out = flagged.withColumn("__o", ordered)
    by_rule = F.when(F.size("__o") > 0, F.col("__o")[0]["outcome"]).otherwise("accepted")
    kept_c = F.col(kept) if kept else F.lit(None).cast("string")
    led = F.col(ledger) if ledger else F.lit(None).cast("string")
    if ledger and failed:
        led = F.when(F.col(failed) & led.isin("accepted", "accepted_with_warnings"), None).otherwise(led)
    return (
        out.withColumn("outcome", F.coalesce(kept_c, led, by_rule))
        .withColumn("decided_by", F.when(kept_c.isNotNull(), "kept").when(led.isNotNull(), "ledger").otherwise("rule"))
        .withColumn("rules", F.transform("__o", lambda x: x["rule"]))
        .drop("__o", "flags")
    )


def page_features(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Links, words, words in links and their share in whole percent (100 if there are no words), and whether the page is navigation-heavy."""
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    anchors = F.expr(r"regexp_extract_all(__body, r'(?is)<a [^>]*>(.*?)</a>', 1)")
    plain = lambda x: F.regexp_replace(x, "<[^>]*>", " ")
    counted = pages.withColumn("__body", body).withColumn("__links", anchors)
    counted = counted.withColumns({"__text": plain(F.col("__body")), "__linked": plain(F.array_join("__links", " "))})
    words, linked = F.expr(T.word_count("__text")), F.expr(T.word_count("__linked"))
    out = counted.withColumns({"links": F.size("__links").cast("long"), "words": words.cast("long"), "link_words": linked.cast("long")})
    percent = F.when(F.col("words") == 0, F.lit(100)).otherwise(F.floor(F.col("link_words") * 100 / F.greatest("words", F.lit(1))))
    return out.withColumn("link_percent", percent.cast("long")).withColumn("navigation_heavy", (F.col("links") >= NAVIGATION_LINKS) & (F.col("link_percent") >= NAVIGATION_PERCENT)).drop("__body", "__links", "__text", "__linked")


def ledger_first_match(rows: DataFrame, rules: DataFrame, fields: list[str], order: str = "position") -> DataFrame:
    """First rule by order whose given fields all equal the row's; a rule that gives none matches nothing. Adds ``rule_id``.

    rules: (position, rule_id, *fields), null where a field is not given. Rules are few and kept by hand;
    more than 100,000 are refused, as they are broadcast. Each combination of given fields is an equi join.
    """
    if rules.limit(100_001).count() > 100_000:
        raise ValueError("a ledger of over 100,000 rules")
    shapes = [r.shape for r in rules.select(F.concat_ws(",", *[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]).alias("shape")).distinct().collect() if r.shape]
    out = rows
    found = []
    for k, shape in enumerate(sorted(shapes)):
        given = shape.split(",")
        own = rules.where(" AND ".join(f"{f} IS {'NOT ' if f in given else ''}NULL" for f in fields))
        best = own.groupBy(*given).agg(F.min(F.struct(order, "rule_id")).alias(f"__m{k}"))
        out = out.join(F.broadcast(best), given, "left")
        found.append(f"__m{k}")
    if not found:
        return out.withColumn("rule_id", F.lit(None).cast("string"))
    best = F.col(found[0]) if len(found) == 1 else F.least(*found)
    return out.withColumn("rule_id", best["rule_id"]).drop(*found)
