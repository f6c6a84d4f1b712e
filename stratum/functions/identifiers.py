"""Exact identifiers in text and what a question asks for, as SQL expressions of built-in functions.

Each family's pattern finds its borders by captured characters, not by look-around, except where Spark
alone uses it. Deviations: commands are back-quoted spans only (``operators/identifier_spans`` has them grown over words and
parameters, with places); paths take a file's ending of letters first.
"""

from __future__ import annotations

from stratum.functions.text import SPARK, Dialect, fold, has_phrase

#: Families in order of priority.
FAMILIES = ("command", "path", "version", "port", "error_code", "parameter")
# A word may not touch a border, so matches could share a separator: it is doubled before matching.
_PATTERNS = {
    "command": r"`([^`\n]+)`",
    "path": r"(?:^|[\s(\[{,;=])((?:[A-Za-z]:\\[^\s]+|\.{1,2}/[^\s]+|~/[^\s]+|/[^\s/:][^\s]*|[\p{L}\p{N}_-]+\.[A-Za-z][A-Za-z0-9]{0,4}))(?:[\s,;!?)\]}.]|$)",
    "version": r"(?:^|[^\p{L}\p{N}_.])([vV][0-9]+(?:\.[0-9]+){0,3}|[0-9]+(?:\.[0-9]+){1,3})(?:$|[^\p{L}\p{N}_.]|\.(?:$|[^0-9]))",
    "port": r"(?:[pP][oO][rR][tT] +|:)([0-9]{1,5})(?:$|[^\p{L}\p{N}_.]|\.(?:$|[^0-9]))",
    "error_code": r"(?:^|[^\p{L}\p{N}_])([A-Z]{1,6}[-_]?[0-9]{2,6}[A-Z]?)(?:$|[^\p{L}\p{N}_])",
    "parameter": r"(?:^|[\s(\[`])(--[A-Za-z][A-Za-z0-9-]*|-[A-Za-z]|[A-Za-z_][A-Za-z0-9_]*=[^\s]+|\$[A-Za-z_][A-Za-z0-9_]*|\$\{[A-Za-z_][A-Za-z0-9_]*\})(?:$|[\s,;.!?)\]}`=])",
}

# What a text with one of a family's identifiers has in it: found by one pass, so most texts are not searched further.
_SIGNS = {
    "command": r"`",
    "path": r"[/\\]|[\p{L}\p{N}_-]\.[A-Za-z]",
    "version": r"[vV][0-9]|[0-9]\.[0-9]",
    "port": r"[tT] +[0-9]|:[0-9]",
    "error_code": r"[A-Z][-_]?[0-9]{2}",
    "parameter": r"(?:^|[\s(\[`])--?[A-Za-z]|=|\$",
}


def found(x: str, family: str, d: Dialect = SPARK) -> str:
    """A family's identifiers, in order."""
    wide = x if family == "command" else d.replace(x, r"(\s)", r"\1\1")
    pattern = _PATTERNS[family]
    out = f"regexp_extract_all({wide}, r'{pattern}', 1)" if d.spark else f"regexp_extract_all({wide}, '{pattern}', 1)"
    if family == "path":
        out = d.only(d.each(out, "p", d.replace("p", r"[,.;!?)\]}]+$", "")), "p", "p <> ''")
    if family == "port":
        out = d.only(out, "p", "cast(p as int) BETWEEN 1 AND 65535")
    return f"CASE WHEN NOT {d.matches(x, _SIGNS[family])} THEN cast(array() as array<string>) ELSE {out} END" if d.spark else out


def index_identifiers(x: str, d: Dialect = SPARK) -> str:
    """All families' identifiers before arbitration, distinct, in binary order."""
    out = found(x, FAMILIES[0], d)
    for family in FAMILIES[1:]:
        out = d.joined(out, found(x, family, d))
    return f"array_sort(array_distinct({out}))" if d.spark else f"list_sort(list_distinct({out}))"


# The phrases that give a question's kind, first match first.
KINDS = (
    ("troubleshooting", ("error", "fails", "failed", "crash", "not working", "erreur", "echoue", "plante", "ne fonctionne pas")),
    ("comparison", ("difference between", "vs", "versus", "compare", "difference entre", "comparer")),
    ("global", ("list all", "all the", "how many", "combien", "tous les", "liste des")),
    ("procedure", ("how to", "how do i", "steps", "configure", "install", "set up", "comment", "etapes", "configurer", "installer")),
    ("concept", ("what is", "what are", "explain", "meaning", "qu'est-ce que", "c'est quoi", "expliquer", "signifie")),
)


def kind(x: str, d: Dialect = SPARK) -> str:
    """What a question is: an error code makes it troubleshooting."""
    quote = "r'[’ʼ]'" if d.spark else "'[’ʼ]'"
    folded = f"regexp_replace(lower({fold(x, d)}), {quote}, {'chr(39)' if d.spark else 'chr(39)' + ', ' + chr(39) + 'g' + chr(39)})"
    size = "size" if d.spark else "len"
    cases = []
    for name, phrases in KINDS:
        tests = [has_phrase(folded, p, d) for p in phrases]
        if name == "troubleshooting":
            tests.append(f"{size}({found(x, 'error_code', d)}) > 0")
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE 'lookup' END"


#: Questions that ask for an inventory, and what is counted or listed.
_INVENTORY = (
    ("count_documents", "how many documents|combien de documents"),
    ("list_sets", "list all document sets|liste des lots de documents"),
    ("list_versions", "list all versions|liste des versions"),
)


def inventory_request(x: str, d: Dialect = SPARK) -> str:
    """The inventory that a question asks for, or null; a set may be named, and one question mark may end it."""
    cases = [f"WHEN {d.matches(f'lower(trim({x}))', rf'^(?:{forms})(?: (?:in set|dans le lot) \"[^\"]*\")?\??$')} THEN '{name}'" for name, forms in _INVENTORY]
    return f"CASE {' '.join(cases)} END"


def language(x: str, d: Dialect = SPARK) -> str:
    """Our own rule in place of a statistical model: the language with most stopwords, of a text of 12 characters or more; ties are unknown."""
    from stratum.functions.text import ENGLISH, FRENCH

    size = "size" if d.spark else "len"
    words = d.split(f"lower({fold(x, d)})", r"[^\p{L}]+")
    count = lambda own, other: f"{size}({d.only(words, 'w', 'w IN (' + ', '.join(repr(w) for w in sorted(set(own) - set(other))) + ')')})"
    en, fr = count(ENGLISH, FRENCH), count(FRENCH, ENGLISH)
    return f"CASE WHEN length(trim({x})) < 12 OR {en} = {fr} THEN 'unknown' WHEN {en} > {fr} THEN 'en' ELSE 'fr' END"
