"""Text analysis for English and French, as SQL expressions of built-in functions.

An expression is made once and serves both Spark and the DuckDB oracle: only how groups are
written in replacements, how lists are mapped and how patterns are quoted differ. Patterns use no
look-around. Deviation: letters and digits are Unicode classes L and N.
"""

from __future__ import annotations

from dataclasses import dataclass

# Stopwords after folding.
ENGLISH = """a about after against although among an and are aren as at be because been before being between but by can
cannot could couldn did didn do does doesn don during for from had hadn has hasn have haven having he her hers herself him
himself his i if in into is isn it its itself ll may me might mine must mustn my myself no nor not of on onto or our ours
ourselves per re shall she should shouldn since so than that the their theirs them themselves these they this those though
through to toward towards under unless until upon us ve via was wasn we were weren what when where whether which while who
whom whose will with within without won would wouldn yet you your yours yourself yourselves""".split()
FRENCH = """a apres as au aura aurait auront aux avaient avait avant avec avez avoir avons c car ce ceci cela celle celles
celui ces cet cette ceux chez comme contre d dans de depuis des devrait doit doivent donc dont du elle elles en entre es est
et etaient etait ete etes etre eux il ils j je jusqu jusque l la laquelle le lequel les lesquelles lesquels leur leurs lorsqu
lorsque lui m ma mais me mes moi mon n ne ni nos notre nous on ont or ou par parmi pas pendant peut peuvent pour pourrait
puisqu puisque qu quand que qui quoi quoiqu quoique s sa sans se selon sera serait seront ses si soi soient soit sommes son
sont sous suis sur t ta te tes toi ton tu un une vers via vos votre vous y""".split()

# BM25 saturation and length normalisation.
K1, B = 1.2, 0.75

_DOUBLES = "bdgmnprt"


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def replace(self, x: str, pattern: str, by: str) -> str:
        """All matches; groups of ``by`` are written \\1."""
        if self.spark:
            return f"regexp_replace({x}, r'{pattern}', r'{by.replace(chr(92), '$')}')"
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def matches(self, x: str, pattern: str) -> str:
        return f"{x} rlike r'{pattern}'" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)" if self.spark else f"regexp_extract_all({x}, '{pattern}')"

    def each(self, xs: str, name: str, body: str) -> str:
        return f"transform({xs}, {name} -> {body})" if self.spark else f"list_transform({xs}, lambda {name}: {body})"

    def only(self, xs: str, name: str, body: str) -> str:
        return f"filter({xs}, {name} -> {body})" if self.spark else f"list_filter({xs}, lambda {name}: {body})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, r'{pattern}')" if self.spark else f"regexp_split_to_array({x}, '{pattern}')"

    def joined(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def many(self, *xs: str) -> str:
        return f"array({', '.join(xs)})" if self.spark else f"[{', '.join(xs)}]"


SPARK, DUCK = Dialect(True), Dialect(False)


def _base_letters() -> tuple[str, str]:
    """Precomposed letters of Latin-1 and Latin Extended-A with a base letter of one character, and these, by Unicode decomposition."""
    import unicodedata

    pairs = []
    for point in range(0xC0, 0x180):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            base = chr(int(parts[0], 16))
            if base.isascii() and 0x300 <= int(parts[1], 16) <= 0x36F:
                pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_whitespace(x: str, d: Dialect = SPARK) -> str:
    """Runs of Unicode white space become one space; none at the ends."""
    space = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+"
    return f"trim({d.replace(x, space, ' ')})"


def fold(x: str, d: Dialect = SPARK) -> str:
    """Base letters in place of accented ones; ligatures spelt out; combining accents dropped."""
    letters, bases = _base_letters()
    out = f"translate({x}, '{letters}', '{bases}')"
    for ligature, spelt in (("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{spelt}')"
    return d.replace(out, r"[\x{300}-\x{36F}]", "")


_CHUNK = r"[\p{L}\p{N}](?:[\p{L}\p{N}_./\\:-]*[\p{L}\p{N}])?"
_JOINERS = r"[-_./\\:]"


def chunks(x: str, d: Dialect = SPARK) -> str:
    """Runs of letters, digits and joiners, without joiners at the ends."""
    return d.found(x, _CHUNK)


def chunk_tokens(c: str, d: Dialect = SPARK) -> str:
    """Tokens of a chunk: an identifier comes whole, marked with ``=``, before its parts, a camel-case word before its."""
    camel = d.replace(d.replace("w", r"([\p{Ll}\p{N}])(\p{Lu})", r"\1 \2"), r"(\p{Lu}{2,})(\p{Lu}\p{Ll}{2})", r"\1 \2")
    split_word = f"CASE WHEN length(w) > 64 OR {camel} = w THEN {d.many('w')} ELSE {d.joined(d.many('w'), d.split(camel, ' '))} END"
    words = lambda xs: f"flatten({d.each(xs, 'w', split_word)})"
    parts = d.only(d.split(c, _JOINERS + "+"), "p", "p <> ''")
    # Most chunks are one word without a border inside: no lambda runs for them.
    plain = f"NOT {d.matches(c, _JOINERS + r'|[\p{Ll}\p{N}]\p{Lu}|\p{Lu}{3}')}"
    return f"CASE WHEN {plain} THEN {d.many(c)} WHEN {d.matches(c, _JOINERS)} THEN {d.joined(d.many(f"concat('=', {c})"), words(parts))} ELSE {words(d.many(c))} END"


def tokens(x: str, d: Dialect = SPARK) -> str:
    """Tokens of folded text in order."""
    return f"flatten({d.each(chunks(x, d), 'c', chunk_tokens('c', d))})"


def stem_steps(d: Dialect = SPARK) -> list[tuple[tuple[str, ...], str]]:
    """The stem's steps in order: the endings without which a step changes nothing, and its expression of ``{w}``."""
    whole = r"([^#]*[aeiouy][^#]{2,}|[^#]+[aeiouy][^#]+|[^#]{2,}[aeiouy][^#]*)"
    rest = r"([^#]*[aeiouy][^#]+|[^#]+[aeiouy][^#]*)"
    pair = "(?:" + "|".join(f"({c}){c}" for c in _DOUBLES) + ")"
    groups = "".join(f"\\{i + 2}" for i in range(len(_DOUBLES)))

    def cut(y: str, endings: str) -> str:
        """The ending goes, with one of two equal consonants before it; ``#`` marks that it did."""
        return d.replace(d.replace(y, f"^{rest}{pair}(?:{endings})$", f"\\1{groups}#"), f"^{whole}(?:{endings})$", r"\1#")

    y = d.replace("{w}", "(ea?u)x$", r"\1")
    y = d.replace(y, "(^|[^e])aux$", r"\1al")
    plural = d.replace(y, "^(.*[aeiouy].*[^su])s$", r"\1")
    y = cut(d.replace("{w}", "ied$", "ie"), "ed|ing")
    english = d.replace(d.replace(y, "^(.{2,}e)ed#$", r"\1"), "#$", "")
    french = d.replace(cut(cut("{w}", "ee"), "e"), "#$", "")
    infinitive = d.replace(cut("{w}", "er"), "#$", "")
    return [(("s", "x"), plural), (("ed", "ing"), english), (("e",), french), (("er",), infinitive), (("y",), d.replace("{w}", "([^aeiouy])y$", r"\1i"))]


def stem(x: str, d: Dialect = SPARK) -> str:
    """Light stem of a lower-case folded word: plural, -ied/-ed/-ing, -ee/-e, -er, final y. A cut leaves three letters or more with a vowel; a word with a digit stays."""
    y = x
    for _, body in stem_steps(d):
        y = body.replace("{w}", y)
    return f"CASE WHEN {d.matches(x, r'\p{N}')} OR NOT {d.matches(x, '(?:[sxey]|ed|ing|er)$')} THEN {x} ELSE {y} END"


def term(t: str, d: Dialect = SPARK) -> str:
    """What a token of ``tokens`` is indexed as; null for a stopword."""
    word = f"lower({d.replace(t, r'^(\p{Lu}{2,})s$', r'\1')})"
    stop = ", ".join(f"'{w}'" for w in sorted({*ENGLISH, *FRENCH}))
    return f"CASE WHEN {t} LIKE '=%' THEN lower(substr({t}, 2)) WHEN {word} IN ({stop}) THEN NULL ELSE {stem(word, d)} END"


def token_id(t: str, d: Dialect = SPARK) -> str:
    """The first four bytes of a term's SHA-256, as an unsigned number."""
    return f"cast(conv(substr(sha2({t}, 256), 1, 8), 16, 10) as bigint)" if d.spark else f"CAST(('0x' || substr(sha256({t}), 1, 8)) AS BIGINT)"


def tf_weight(tf: str, length: str, average: str) -> str:
    """BM25's saturated term frequency."""
    return f"({tf} * {K1 + 1} / ({tf} + {K1} * ({1 - B} + {B} * {length} / {average})))"


def word_count(x: str, d: Dialect = SPARK) -> str:
    """Runs without white space that hold a letter or digit."""
    words = d.only(d.split(x, r"\s+"), "w", d.matches("w", r"[\p{L}\p{N}]"))
    return f"size({words})" if d.spark else f"len({words})"


def prompt_form(x: str, d: Dialect = SPARK) -> str:
    """Lower case; runs of other than letters and digits become one space."""
    return f"trim({d.replace(f'lower({x})', r'[^\p{L}\p{N}]+', ' ')})"


def has_phrase(x: str, phrase: str, d: Dialect = SPARK) -> str:
    """Whether a phrase is in ``x`` and touches no word character."""
    quoted = "".join(f"[{c}]" if not c.isalnum() and c not in " '" else c for c in phrase).replace("'", "''" if not d.spark else r"\x27")
    return d.matches(x, rf"(^|[^\p{{L}}\p{{N}}_]){quoted}([^\p{{L}}\p{{N}}_]|$)")


# Escapes of marks in generated text, in the order in which they are undone.
ENTITIES = (("\\u003c", "<"), ("\\u003e", ">"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
UNESCAPE_PASSES = 24


def unescape(x: str, d: Dialect = SPARK) -> str:
    """Entities undone, then backslashes before ASCII punctuation dropped until none is left: a pass halves a run of them, so these serve runs of 2**24."""
    quote = lambda v: "'" + (v.replace("\\", "\\\\").replace("'", "\\'") if d.spark else v.replace("'", "''")) + "'"
    out = x
    for escaped, plain in ENTITIES:
        out = f"replace({out}, {quote(escaped)}, {quote(plain)})"
    mark = r"\\\\([!-/:-@\[-`{-~])"
    if d.spark:
        return f"aggregate(sequence(1, {UNESCAPE_PASSES}), {out}, (s, i) -> if(contains(s, '\\\\'), regexp_replace(s, r'{mark[2:]}', '$1'), s))"
    return f"list_reduce(list_concat([{out}], list_transform(range({UNESCAPE_PASSES}), lambda i: '')), lambda s, i: regexp_replace(s, '{mark[2:]}', '\\1', 'g'))"
