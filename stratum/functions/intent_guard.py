"""What a generated expansion of a question must keep, as one SQL expression of built-in functions.

Words are compared folded to lower case and without articles; numbers in any spelling are one token.
"""

from __future__ import annotations

import re

from stratum.functions.identifiers import index_identifiers

# Word lists of English and French, and the longest passage and keywords in bytes.
ARTICLES = "a an the le la les l un une des".split()
RELATIONS = "from after before without only until sans avant après depuis seulement uniquement jusqu'à".split()
CONSTRAINTS = "no not never except unless at least most don't cannot can't pas jamais aucun aucune sauf ni".split()
QUANTITIES = {
    "zero": 0, "one": 1, "first": 1, "two": 2, "second": 2, "three": 3, "third": 3, "four": 4, "fourth": 4, "five": 5, "fifth": 5, "six": 6, "sixth": 6,
    "seven": 7, "seventh": 7, "eight": 8, "eighth": 8, "nine": 9, "ninth": 9, "ten": 10, "tenth": 10,
    "zéro": 0, "premier": 1, "première": 1, "deux": 2, "deuxième": 2, "seconde": 2, "trois": 3, "troisième": 3, "quatre": 4, "quatrième": 4, "cinq": 5, "cinquième": 5,
    "sixième": 6, "sept": 7, "septième": 7, "huit": 8, "huitième": 8, "neuf": 9, "neuvième": 9, "dix": 10, "dixième": 10,
}
ORDINAL_ENDINGS = "st nd rd th e er re ème eme ième".split()
MOST_PASSAGE, MOST_KEYWORDS = 2048, 512


def _listed(words: list[str]) -> str:
    return ", ".join('"' + w + '"' for w in words)


def tokens(x: str) -> str:
    """The words that the guard compares: ``#`` and decimal digits for a quantity, else the word."""
    words = f"""filter(transform(split(replace({x}, '’', chr(39)), r'[^\\p{{L}}\\p{{N}}\\x27]+'), w -> lower(regexp_replace(w, r'^\\x27+|\\x27+$', ''))), w -> w <> '' AND NOT w IN ({_listed(ARTICLES)}))"""
    named = "map(" + ", ".join(f'"{k}", "{v}"' for k, v in QUANTITIES.items()) + ")"
    numeral = f"r'^0*([0-9]+?)({'|'.join(ORDINAL_ENDINGS)})?$'"
    return f"transform({words}, w -> CASE WHEN regexp_like(w, {numeral}) THEN concat('#', regexp_extract(w, {numeral}, 1)) WHEN {named}[w] IS NOT NULL THEN concat('#', {named}[w]) ELSE w END)"


def verdict(question: str, passage: str, keywords: str) -> str:
    """``accepted``, or the first rule that an expansion breaks: empty, oversize, protected_missing, added_number, identifier_missing, identifier_added.

    The arguments are columns; nulls count as empty. Quantities and constraint words of the question, and relations with the word
    that they bind, must stand in the passage; no quantity may be new; identifiers may be neither lost nor new.
    """
    q, p, k = (f"coalesce({x}, '')" for x in (question, passage, keywords))
    width = f"CASE WHEN q[i] LIKE '#%' THEN 1 WHEN q[i] IN ({_listed(RELATIONS)}) THEN 2 WHEN q[i] IN ({_listed(CONSTRAINTS)}) THEN 1 ELSE 0 END"
    kept = f"forall(sequence(0, size(q) - 1), i -> size(q) = 0 OR ({width}) = 0 OR exists(sequence(0, size(p) - 1), j -> size(p) > 0 AND slice(p, j + 1, size(slice(q, i + 1, {width}))) = slice(q, i + 1, {width})))"
    added = "exists(g, w -> w LIKE '#%' AND NOT array_contains(q, w))"
    blank = lambda x: f"trim(regexp_replace({x}, r'\\s+', ' ')) = ''"
    bound = re.sub(r"\b([qpg])(?=[\[,)])", r"s.\1", f"{kept}|{added}").split("|")
    steps = (
        f"CASE WHEN {blank(p)} OR {blank(k)} THEN 'empty' WHEN octet_length({p}) > {MOST_PASSAGE} OR octet_length({k}) > {MOST_KEYWORDS} THEN 'oversize' "
        f"WHEN NOT {bound[0]} THEN 'protected_missing' WHEN {bound[1]} THEN 'added_number' "
        f"WHEN exists(s.qi, x -> NOT contains({p}, x)) THEN 'identifier_missing' WHEN exists(s.gi, x -> NOT array_contains(s.qi, x)) THEN 'identifier_added' ELSE 'accepted' END"
    )
    both = f"concat({p}, ' ', {k})"
    held = f"named_struct('q', {tokens(q)}, 'p', {tokens(p)}, 'g', {tokens(both)}, 'qi', {index_identifiers(q)}, 'gi', {index_identifiers(both)})"
    # Bound once, so that nothing is split again for each word.
    return f"transform(array({held}), s -> {steps})[0]"
