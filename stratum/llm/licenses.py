"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above. DataFrame functions only.

The vector space has the templates' terms and one more for all other terms. Document frequencies are
counted over all files. Units are a file's lines, its neighbouring lines that aren't blank joined by twos,
its whole text, and windows: as many consecutive terms as a template has, at every place of the text,
across lines. Equal units are scored once. A unit can reach ``LINE_COSINE`` only if it has one of the cue
terms: for all other terms together, every template's part in them is below that bound (Cauchy-Schwarz),
so leaving out units without a cue loses none. A window is scored against the templates of its length and,
as nothing dilutes a notice there, holds from ``WINDOW_COSINE``: at less, a lone "MIT" would be a notice.

A whole text is also scored against the texts of licences (``FULL_TEXTS``), by the cosine of the sets of
three terms in a row; from ``FILE_COSINE`` that decides before any notice, as such texts name other licences.

A file speaks for its directory if it has a licence file's name, or if its whole text is a notice or a
licence's text (``FILE_COSINE``). A file without a licence of its own gets that of the nearest such directory above.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import hot_keys, join_to_one
from stratum.runtime import settle
from stratum.sources.tables import table

LINE_COSINE = 0.6
FILE_COSINE = 0.85
WINDOW_COSINE = 0.85
LICENCE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
#: Texts of licences by SPDX identifier; each has one of the words, and so has what is compared with them.
FULL_TEXTS = Path(__file__).resolve().parent / "licence_texts"
_FULL_WORDS = ("license", "permission", "redistribution", "unencumbered")
#: Notices by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: All but a-z, 0-9 and dots ends a term, whatever its script; a dot does unless a digit follows. These are the ASCII ones.
_MARKS = "".join(c for c in map(chr, range(128)) if not re.match("[a-z0-9.]", c))
_OTHER = "<other>"
#: Template terms so common in any text that units with no other template term are left out at the first pass. That this
#: loses none is verified once document frequencies are known; if it weren't so, all texts would be kept.
_COMMON = ("all", "and", "any", "are", "by", "for", "in", "into", "is", "of", "or", "the", "this", "to", "under", "use", "with", "without")


def terms_of(text: str) -> list[str]:
    """What the SQL expression of ``_terms`` gives."""
    return [w for w in re.split(r"(?:[^a-z0-9.]|\.(?![0-9]))+", text.lower()) if w]


def _words(column: str) -> str:
    """Terms and empty strings of lower-case text: runs outside ASCII and dots by pattern, the other marks by ``translate``, then splitting at a plain character."""
    marks = "".join(f"\\u{ord(c):04x}" for c in _MARKS)
    return f"split(translate(regexp_replace({column}, '[^\\\\x00-\\\\x7f]+|\\\\.(?![0-9])', ' '), '{marks}', '{' ' * len(_MARKS)}'), ' ')"


def _terms(column: str) -> str:
    return f"filter({_words(column)}, w -> w <> '')"


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _idf(held: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Smoothed inverse document frequency of each template term and of the rest, over all files; one number a term comes to the driver."""
    marked = held.select(F.concat("terms", F.when(F.col("other"), F.array(F.lit(_OTHER))).otherwise(F.expr("cast(array() as array<string>)")), F.array(F.lit(""))).alias("words"))
    df = {r.word: r.n for r in marked.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = df.get("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in [*vocabulary, _OTHER]}


def _cues(idf: dict[str, float], templates: list[tuple[str, dict[str, int]]], least: float) -> list[str]:
    """The terms of which a unit needs one: all but the most frequent ones whose part in every template is below ``least``."""
    weights = [{t: n * idf[t] for t, n in terms.items()} for _, terms in templates]
    norms = [math.sqrt(sum(v * v for v in w.values())) for w in weights]
    parts, common = [0.0] * len(weights), set()
    for term in sorted((t for t in idf if t != _OTHER), key=lambda t: (idf[t], t)):
        grown = [p + w.get(term, 0.0) ** 2 for p, w in zip(parts, weights, strict=True)]
        if all(math.sqrt(g) < least * n - 1e-9 for g, n in zip(grown, norms, strict=True)):
            parts = grown
            common.add(term)
    return sorted(set(idf) - common - {_OTHER})


def _reach(column: str, templates: list[dict[str, int]], idf: dict[str, float], least: float) -> str:
    """Whether the terms in ``column`` can reach ``least`` with one of the templates: its part in them is that large (Cauchy-Schwarz)."""
    shares = []
    for terms in templates:
        weights = {t: (n * idf[t]) ** 2 for t, n in terms.items()}
        shares.append("array(" + ", ".join(f"struct('{t}' AS t, {w / sum(weights.values())!r}D AS p)" for t, w in sorted(weights.items())) + ")")
    return f"exists(array({', '.join(shares)}), k -> aggregate(k, 0D, (s, x) -> s + if(array_contains({column}, x.t), x.p, 0D)) >= {least**2 - 1e-9!r}D)"


def _windows(templates: list[dict[str, int]], idf: dict[str, float]) -> str:
    """Of the term array ``all``: the windows (m, unit) that can reach WINDOW_COSINE with a template of their length; those around a cue, each once."""
    parts = []
    for m in sorted({sum(t.values()) for t in templates}):
        fitting = [t for t in templates if sum(t.values()) == m]
        cues = _array(_cues(idf, [("", t) for t in fitting], WINDOW_COSINE))
        places = f"filter(sequence(1, size(all)), p -> array_contains({cues}, element_at(all, p)))"
        starts = f"array_distinct(flatten(transform({places}, p -> sequence(greatest(1, p - {m - 1}), p))))"
        cut = f"array_distinct(transform(filter({starts}, i -> i + {m - 1} <= size(all)), i -> slice(all, i, {m})))"
        parts.append(f"transform(filter({cut}, w -> {_reach('w', fitting, idf, WINDOW_COSINE)}), w -> struct({m} AS m, array_join(w, ' ') AS unit))")
    return f"if(size(all) = 0, array(), concat({', '.join(parts)}))"


def _triples(terms: str) -> str:
    """The set of three terms in a row, as hashes; empty of fewer than three."""
    return f"if(size({terms}) < 3, cast(array() as array<bigint>), array_distinct(transform(sequence(1, size({terms}) - 2), i -> xxhash64(slice({terms}, i, 3)))))"


def _full_matches(texts: DataFrame) -> DataFrame:
    """(doc_id, path, license, cosine) of whole texts (doc_id, path, uid, all) that are a licence's text."""
    rows = ", ".join(f"('{f.stem}', '{' '.join(terms_of(f.read_text()))}')" for f in sorted(FULL_TEXTS.glob("*.txt")))
    full = texts.sparkSession.sql(f"SELECT license, {_triples('w')} AS t FROM (SELECT license, split(text, ' ') AS w FROM VALUES {rows} AS t(license, text))")
    full = settle(full.select("license", F.size("t").alias("size"), F.explode("t").alias("triple")), "full-texts")
    held = settle(texts.select("doc_id", "path", "uid", F.expr(_triples("all")).alias("t")), "triples")
    parts = held.groupBy("uid").agg(F.first("t").alias("t")).select("uid", F.size("t").alias("n"), F.explode("t").alias("triple"))
    shared = parts.join(F.broadcast(full), "triple").groupBy("uid", "license", "n", "size").agg(F.count(F.lit(1)).alias("shared"))
    cosine = shared.select("uid", "license", F.round(F.col("shared") / F.sqrt(F.col("n").cast("double") * F.col("size")), 6).alias("cosine")).where(F.col("cosine") >= FILE_COSINE)
    best = settle(cosine.groupBy("uid").agg(F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license"))).alias("b")).select("uid", "b.license", (-F.col("b.order")).alias("cosine")), "full-best")
    uses = held.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return join_to_one(held.select("doc_id", "path", "uid"), best, hot_keys(uses, "uid"), "uid").where("license IS NOT NULL").drop("uid")


def _dir(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(doc_id, path, license, how, cosine, from_dir) of every row.

    how: ``own`` (a unit or the whole text reaches its bound), ``inherited`` or ``none``; cosine is
    that of the deciding unit, rounded to six digits; from_dir the directory inherited from, else null.
    Of equal cosines the first licence by name holds. Null text: no terms; null path: a file in the
    root directory. Rows with the same id and path share one result; each gets a row. No rows give none.
    Only the named columns are read.
    """
    spark = files.sparkSession
    chosen = files.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counted = []
    for name, text in templates:
        terms: dict[str, int] = {}
        for w in terms_of(text):
            terms[w] = terms.get(w, 0) + 1
        counted.append((name, terms))
    vocabulary = sorted({t for _, terms in counted for t in terms})
    if len(vocabulary) > 20_000:
        raise ValueError("templates are meant to be few: their terms are broadcast")
    # One pass over all texts: each file's template terms, and the text only where it can matter.
    uncommon = _array([w for w in vocabulary if w not in _COMMON])
    worded = chosen.select("doc_id", "path", F.lower("text").alias("text")).withColumn("words", F.expr(f"array_distinct({_words('text')})"))
    listed = worded.withColumn("terms", F.expr(f"array_intersect(words, {_array(vocabulary)})")).withColumn("other", F.expr("size(words) > size(terms) + int(array_contains(words, ''))"))
    pruned = settle(listed.select("doc_id", "path", "terms", "other", F.when(F.expr(f"arrays_overlap(terms, {uncommon})"), F.col("text")).alias("text")), "pruned")
    idf = _idf(pruned, vocabulary)
    cue_terms = _cues(idf, counted, LINE_COSINE)
    cues = _array(cue_terms)
    # Units with a cue: lines and pairs of lines, and whole texts of files with such a line. Windows where the file has the terms for one.
    whole_cues = set(cue_terms) & set(_COMMON)
    cued = listed if whole_cues else pruned.where("text IS NOT NULL")
    by_length = [terms for _, terms in counted]
    # One use of the terms: where they aren't read from a table, each use splits the text again.
    cued = cued.where(F.expr(f"arrays_overlap(terms, {_array(sorted({*cue_terms, *_FULL_WORDS}))})"))
    lined = settle(cued.select("doc_id", "path", F.expr(f"filter(transform(split(text, '\\\\n'), l -> {_terms('l')}), l -> size(l) > 0)").alias("lines")), "lines")
    split_up = settle(lined.withColumn("all", F.flatten("lines")).withColumn("terms", F.expr(f"array_intersect(all, {_array(vocabulary)})")), "split")
    unit = lambda x, whole=False: F.struct(F.lit(whole).alias("whole"), F.lit(None).cast("int").alias("m"), F.array_join(x, " ").alias("unit"))
    paired = F.expr("if(size(lines) < 2, cast(array() as array<array<string>>), transform(sequence(1, size(lines) - 1), i -> concat(element_at(lines, i), element_at(lines, i + 1))))")
    with_cue = F.filter(F.concat("lines", paired), lambda x: F.arrays_overlap(x, F.expr(cues)))
    windows = F.when(F.expr(_reach("terms", by_length, idf, WINDOW_COSINE)), F.transform(F.expr(_windows(by_length, idf)), lambda x: F.struct(F.lit(False).alias("whole"), x.m.alias("m"), x.unit.alias("unit"))))
    wholes = F.when(F.expr(f"arrays_overlap(terms, {cues})"), F.array(unit(F.col("all"), True)))
    none = F.array().cast("array<struct<whole:boolean,m:int,unit:string>>")
    every = F.concat(F.transform(with_cue, lambda x: unit(x)), F.coalesce(wholes, none), F.coalesce(windows, none))
    units = settle(split_up.select("doc_id", "path", F.explode(every).alias("u")).select("doc_id", "path", "u.whole", "u.m", "u.unit", F.md5(F.concat_ws(":", F.coalesce(F.col("u.m").cast("string"), F.lit("")), "u.unit")).alias("uid")), "units")
    full = _full_matches(split_up.where(F.expr(f"arrays_overlap(terms, {_array(list(_FULL_WORDS))})")).select("doc_id", "path", F.md5(F.array_join("all", " ")).alias("uid"), "all"))
    # A unit goes by its hash from here on: whole texts are carried through one aggregation only.
    seen = units.groupBy("uid").agg(F.first("unit").alias("unit"), F.first("m").alias("m"))
    known = _array(vocabulary)
    tf = seen.select("uid", "m", F.explode(F.expr(f"transform(split(unit, ' '), w -> if(array_contains({known}, w), w, '{_OTHER}'))")).alias("term")).groupBy("uid", "m", "term").agg(F.count(F.lit(1)).alias("tf"))
    rows = ", ".join(f"('{w}', {v!r}D)" for w, v in sorted(idf.items()))
    weights = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(term, idf)"))
    vectors = tf.join(weights, "term").select("uid", "m", "term", (F.col("tf") * F.col("idf")).alias("w"))
    parts = []
    for k, (name, terms) in enumerate(counted):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in terms.items()))
        parts += [f"('{t}', {k}, '{name}', {sum(terms.values())}, {n * idf[t] / norm!r}D)" for t, n in sorted(terms.items())]
    sides = F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(parts)} AS t(term, template, license, length, part)"))
    norms = vectors.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.join(sides, "term").where("m IS NULL OR m = length").groupBy("uid", "m", "template", "license").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    cosine = dots.join(norms, "uid").select("uid", "license", "m", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= F.when(F.col("m").isNull(), LINE_COSINE).otherwise(WINDOW_COSINE))
    best = settle(cosine.groupBy("uid").agg(F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license"))).alias("b")).select("uid", "b.license", (-F.col("b.order")).alias("cosine")), "best")
    uses = units.groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    matched = join_to_one(units.drop("unit", "m"), best, hot_keys(uses, "uid"), "uid").where("license IS NOT NULL")
    first = F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license")))
    matched = matched.select("doc_id", "path", F.lit(1).alias("after"), "whole", "license", "cosine").unionByName(full.select("doc_id", "path", F.lit(0).alias("after"), F.lit(True).alias("whole"), "license", "cosine"))
    deciding = F.min(F.struct("after", (-F.col("cosine")).alias("order"), F.col("license")))
    own = settle(matched.groupBy("doc_id", "path").agg(deciding.alias("b"), F.max(F.when(F.col("whole"), F.col("cosine"))).alias("whole")).select("doc_id", "path", "b.license", (-F.col("b.order")).alias("cosine"), "whole"), "own")
    # Directories that a file speaks for, then every directory's nearest one at or above it.
    speaks = own.where(F.col("path").rlike(LICENCE_NAMES) | (F.col("whole") >= FILE_COSINE)).withColumn("dir", F.expr(_dir("path")))
    first = F.min(F.struct((-F.col("cosine")).alias("order"), F.col("license")))
    licensed = speaks.groupBy("dir").agg(first.alias("b")).select(F.col("dir").alias("from_dir"), "b.license", (-F.col("b.order")).alias("cosine"))
    placed = settle(chosen.select("doc_id", "path", F.expr(_dir("path")).alias("dir")), "placed")
    counts = placed.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    above = counts.select("dir", F.expr("split(dir, '/')").alias("p")).select("dir", F.posexplode(F.expr("transform(sequence(size(p), 0, -1), k -> array_join(slice(p, 1, k), '/'))")).alias("distance", "from_dir")).distinct()
    nearest = above.join(licensed, "from_dir").groupBy("dir").agg(F.min(F.struct("distance", "from_dir", "license", "cosine")).alias("b"))
    dirs = settle(nearest.select("dir", F.col("b.from_dir").alias("from_dir"), F.col("b.license").alias("i_license"), F.col("b.cosine").alias("i_cosine")), "dirs")
    keyed = placed.withColumn("key", F.struct("doc_id", "path"))
    mine = own.select(F.struct("doc_id", "path").alias("key"), "license", "cosine")
    found = join_to_one(keyed.join(mine, "key", "left").drop("key"), dirs, hot_keys(counts, "dir"), "dir")
    has = F.col("license").isNotNull()
    return found.select(
        "doc_id", "path", F.coalesce("license", "i_license").alias("license"),
        F.when(has, "own").when(F.col("i_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.coalesce("cosine", "i_cosine").alias("cosine"), F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/group/doc_id.txt``, a hundred ids a group."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(docs.select("doc_id", path.alias("path"), "text"))
