"""Operators against brute force, library results and exact round trips."""

from __future__ import annotations

import hashlib
import random
import re
import shutil
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratum.llm import bpe, chat, idstore, licenses, media, quality, registry, ring, sentencepiece_viterbi, simhash, token_counts, winnow
from stratum.llm.common import hot_keys, join_to_one
from stratum.llm.components import components
from tests.llm.conftest import SF


def pairs_of(rows):
    return Counter((r.doc_id, r.text or "") for r in rows)


# 1


def test_media_round_trip(spark, odd, odd_rows, none):
    files = media.to_media(odd)
    rows = media.digest_media(files).collect()
    want = Counter()
    for i, t in odd_rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    assert {(r.media_bytes, r.media_sha256) for r in rows} == {(len(x.media), hashlib.sha256(x.media).hexdigest()) for x in files.collect()}
    assert len({(r.payload_sha256, r.feature, r.media_sha256) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media.digest_media(media.to_media(none)).count() == 0


def test_lossless_frames_of_noise_and_extremes():
    rng = np.random.default_rng(0)
    frames = np.concatenate([rng.integers(0, 256, (5, 24, 24)), np.zeros((1, 24, 24)), np.full((1, 24, 24), 255), np.indices((24, 24)).sum(0)[None] % 2 * 255]).astype(np.uint8)
    assert all((a == b).all() for a, b in zip(media.decode_frames(media.encode_frames(frames)), frames, strict=True))


def test_long_files_are_coded_in_slices():
    frames = np.random.default_rng(1).integers(0, 256, (14_000, 24, 24)).astype(np.uint8)
    tracemalloc.start()
    coded = media.encode_frames(frames)
    assert tracemalloc.get_traced_memory()[1] < 250 << 20  # 120 bytes a sample would be 970 MB
    tracemalloc.reset_peak()
    got = media.decode_frames([*coded[:4000], b"", *coded[4000:]])
    assert tracemalloc.get_traced_memory()[1] < 250 << 20
    tracemalloc.stop()
    assert got[4000] is None
    assert all((a == b).all() for a, b in zip(got[:4000] + got[4001:], frames, strict=True))
    assert media.encode_frames(frames[1000:1002]) == coded[1000:1002]
    assert media.encode_frames(frames[:0]) == []


def baseline_jpeg(blocks: np.ndarray, width: int, height: int) -> bytes:
    """A tiny baseline encoder for the test: quantised coefficients [block, 64] in scan order, a table of 8-bit codes."""
    symbols = sorted({0, 0xF0} | {(r << 4) | s for r in range(16) for s in range(1, 11)})
    ac = {s: format(k, "08b") for k, s in enumerate(symbols)}
    dc = {s: format(k, "04b") for k, s in enumerate(range(12))}
    extra = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << int(abs(v)).bit_length()) - 1, f"0{int(abs(v)).bit_length()}b")
    bits, last = "", 0
    for b in blocks.tolist():
        d, last = b[0] - last, b[0]
        bits += dc[int(abs(d)).bit_length()] + extra(d)
        run = 0
        for v in b[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits += ac[0xF0]
                run -= 16
            bits += ac[(run << 4) | int(abs(v)).bit_length()] + extra(v)
            run = 0
        if run:
            bits += ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    counts = lambda n, length: bytes([n if k == length else 0 for k in range(1, 17)])
    head = seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
    head += seg(0xC4, b"\0" + counts(12, 4) + bytes(range(12))) + seg(0xC4, b"\x10" + counts(len(symbols), 8) + bytes(symbols))
    return b"\xff\xd8" + head + seg(0xDA, struct.pack(">B2B3B", 1, 1, 0, 0, 63, 0)) + scan + b"\xff\xd9"


def test_baseline_frames():
    rng = np.random.default_rng(1)
    blocks = np.where(rng.random((6, 64)) < 0.3, rng.integers(-40, 40, (6, 64)), 0)
    got = media.decode_frames([baseline_jpeg(blocks, 20, 14)])[0]
    want = np.zeros((16, 24))
    for n, b in enumerate(blocks):
        c = np.zeros(64)
        c[media._ZIGZAG] = b * 2
        c = c.reshape(8, 8)
        y, x = n // 3 * 8, n % 3 * 8
        for i in range(8):
            for j in range(8):
                want[y + i, x + j] = sum((0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) / 4 * c[u, v] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    assert got.shape == (14, 20) and (got == np.clip(np.rint(want) + 128, 0, 255)[:14, :20]).all()


def test_frames_with_the_standard_tables():
    """A frame without Huffman tables decodes as one that brings the standard's."""
    dc, ac = media._codes(media.DC_COUNTS, media.DC_SYMBOLS), media._codes(media.AC_COUNTS, media.AC_SYMBOLS)
    word = lambda c: format(c[0], f"0{c[1]}b")
    bits = word(dc[3]) + "101" + word(ac[0x01]) + "1" + word(ac[0x12]) + "10" + word(ac[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    start = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([3] * 64)) + seg(0xC0, struct.pack(">BHHB3B", 8, 8, 8, 1, 1, 0x11, 0))
    tables = seg(0xC4, b"\0" + bytes(media.DC_COUNTS) + bytes(media.DC_SYMBOLS)) + seg(0xC4, b"\x10" + bytes(media.AC_COUNTS) + media.AC_SYMBOLS)
    end = seg(0xDA, struct.pack(">B2B3B", 1, 1, 0, 0, 63, 0)) + scan + b"\xff\xd9"
    plain, full = media.decode_frames([start + end, start + tables + end])
    assert plain.shape == (8, 8) and (plain == full).all() and len(set(plain.ravel().tolist())) > 2


def test_avi_of_several_parts_and_streams():
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    stream = lambda kind: chunk(b"LIST", b"strl" + chunk(b"strh", kind + bytes(52)))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 50_000, *[0] * 13)) + stream(b"auds") + stream(b"vids") + stream(b"vids"))
    movi = chunk(b"LIST", b"movi" + chunk(b"00wb", b"sound") + chunk(b"LIST", b"rec " + chunk(b"01dc", b"one") + chunk(b"02dc", b"other")) + chunk(b"01dc", b"two"))
    more = chunk(b"RIFF", b"AVIX" + chunk(b"LIST", b"movi" + chunk(b"01dc", b"three") + chunk(b"01db", b"four")))
    assert media.parse_avi(chunk(b"RIFF", b"AVI " + head + movi) + more) == (20.0, [b"one", b"two", b"three", b"four"])
    indexed = media.write_avi([b"first", b"second"], 8, 8, 10)
    assert media.parse_avi(indexed + more) == (10.0, [b"first", b"second"])
    assert media.parse_avi(indexed + more.replace(b"01d", b"00d")) == (10.0, [b"first", b"second", b"three", b"four"])


def test_shots_and_damage(spark):
    dark, light = np.zeros((24, 24), np.uint8), np.full((24, 24), 200, np.uint8)
    frames = media.encode_frames(np.stack([dark] * 6 + [light] * 4))
    file = media.write_avi(frames, 24, 24, 10)
    rows = media.clips(spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"RIFFxx")), (4, bytearray(file[:200]))], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.first_frame, r.end_frame, r.begin_s, r.end_s) for r in rows] == [(1, 0, 6, 0.0, 0.6), (1, 6, 10, 0.6, 1.0)]
    no_index = file[: file.rindex(b"idx1")]
    assert media.parse_avi(no_index)[1] == media.parse_avi(file)[1] == frames
    hurt = media.decode_frames([frames[0], frames[1][:-6], b"", frames[2]])
    assert hurt[0] is not None and hurt[2] is None and hurt[3] is not None


# 2


def test_sentencepiece_equals_the_library(spark, documents, odd, odd_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.default_model())
    model = sentencepiece_viterbi.load(sentencepiece_viterbi.default_model())
    random.seed(2)
    letters = "abcdefghijklmnopqrstuvwxyz  .,éà漢字\n\t12<>_()▁THE"
    texts = [r.text for r in documents.collect()] + [t or "" for _, t in odd_rows] + ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(2000)] + [" " * 40 + "a", "  lead", "trail  "]
    got = model.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library.encode(texts)
    assert all(a == b.encode() for a, b in zip(model.decode(got), texts, strict=True) if "▁" not in b)
    rows = sentencepiece_viterbi.encode_decode(odd).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(odd_rows)
    want = Counter((i, len(library.encode(t or "")), zlib.crc32(np.array(library.encode(t or ""), "<u4").tobytes())) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_sentencepiece_of_nothing(spark, none):
    assert sentencepiece_viterbi.encode_decode(none).count() == 0
    row = sentencepiece_viterbi.encode_decode(none.sparkSession.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (row.n_tokens, row.round_trip) == (0, True)


def test_unigram_viterbi_equals_the_library(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    random.seed(4)
    spec = pb.ModelProto()
    spec.trainer_spec.model_type = 1
    spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        spec.pieces.add(piece=piece, score=0, type=kind)
    words = {"▁", *"abcd", *("".join(random.choices("abcd", k=random.randint(2, 5))) for _ in range(80)), *("▁" + "".join(random.choices("abcd", k=3)) for _ in range(20))}
    for n, w in enumerate(sorted(words)):
        spec.pieces.add(piece=w, score=-1 - random.random() * 8 - n * 1e-4, type=1)
    (tmp_path / "u.model").write_bytes(spec.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    texts = ["".join(random.choices("abcd ", k=random.randint(0, 40))) for _ in range(500)]
    model = sentencepiece_viterbi.Model(spec.SerializeToString())
    got, want = [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)], library.encode(texts)
    score = lambda ids: sum(spec.pieces[i].score for i in ids)
    # Ways of the same pieces in another order tie; rounding along the text decides in the library.
    assert all(a == b or (sorted(a) == sorted(b) and abs(score(a) - score(b)) < 1e-9) for a, b in zip(got, want, strict=True))
    assert sum(a == b for a, b in zip(got, want, strict=True)) > 450
    assert model.decode(model.encode(texts)) == [t.encode() for t in texts]


# 3


def test_ring_laws(spark, documents, odd, none):
    for docs, n in ((documents, documents.count()), (odd, odd.count())):
        rows = ring.shard_rows(docs).collect()
        counts = Counter(r.shard for r in rows)
        assert len(rows) == n and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == min(8, n)
        assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(c)) for s, c in counts.items())
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    assert ring.shard_rows(none).count() == 0
    loose = {r.doc_id: r.shard for r in ring.shard_rows(documents, shards=8, slack=0.25).collect()}
    more = {r.doc_id: r.shard for r in ring.shard_rows(documents, shards=9, slack=0.25).collect()}
    assert max(Counter(loose.values()).values()) <= -(-len(loose) * 5 // 32) and sum(loose[i] != more[i] for i in loose) < 0.4 * len(loose)


def test_ring_equals_sql(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert {(d, s, slot) for d, s, slot in con.execute(f"SELECT doc_id, shard, slot FROM ({ring._oracle()})").fetchall()} == {(r.doc_id, r.shard, r.slot) for r in ring.shard_rows(documents).collect()}


# 4


def rendered(turns):
    text, spans = "", []
    for role, body in turns:
        head = f"<|{role}|>\n"
        if role == "assistant":
            spans.append(f"{len(text) + len(head)}-{len(text) + len(head) + len(body) + 7}")
        text += f"{head}{body}<|end|>\n"
    return text, ",".join(spans)


def test_preference_pairs(spark):
    rows = [(1, False, 0, "user", "q"), (1, False, 1, "assistant", "é good"), (1, False, 2, None, None), (1, True, 0, "user", "q"), (1, True, 1, "assistant", "bad"), (2, False, 0, "user", "alone"), (3, False, 0, "user", "same"), (3, True, 0, "user", "same"), (None, False, 0, "user", "x"), (4, True, 0, "assistant", ""), (4, True, 0, "assistant", "")]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, "pair_id long, is_rejected boolean, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].prompt == rendered([("user", "q")])[0] and (got[1].chosen, got[1].chosen_mask) == rendered([("assistant", "é good"), ("unknown", "")]) and (got[1].rejected, got[1].rejected_mask) == rendered([("assistant", "bad")])
    assert got[2].prompt == "" and got[2].rejected == "" and got[3].prompt_turns == 1 and got[3].chosen == got[3].rejected == ""
    assert (got[4].rejected, got[4].rejected_mask) == rendered([("assistant", ""), ("assistant", "")])
    assert chat.preference_pairs(spark.createDataFrame([], "pair_id long, is_rejected boolean, turn long, role string, text string")).count() == 0


def test_swapped_answers_brute_force(spark):
    long = "word " * 20_000
    talks = {
        0: [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "thanks")], 1: [("user", "q2"), ("assistant", long)], 2: [("user", "alone")], 3: [("user", "x"), ("assistant", None)],
        4: [("user", "no neighbour"), ("assistant", "b")], 6: [("assistant", "same")], 7: [("assistant", "same")], -2: [(None, "é"), ("assistant", "")], -1: [("assistant", "c")],
    }
    rows = [(i, k, r, t, 9, "p", True) for i, talk in talks.items() for k, (r, t) in enumerate(talk)] + [(None, 0, "user", "x", 9, "p", True)]
    schema = "conv_id long, turn long, role string, text string, pair_id long, prompt string, is_rejected boolean"
    got = {r.pair_id: r for r in chat.swapped_answers(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(talks)
    plain = {i: [(r or "unknown", t or "") for r, t in talk] for i, talk in talks.items()}
    for i, talk in plain.items():
        mine = [k for k, (r, _) in enumerate(talk) if r == "assistant"]
        theirs = [x for x in plain.get(i ^ 1, []) if x[0] == "assistant"]
        other = talk[: mine[-1]] if mine else talk
        other = other + theirs[-1:]
        n = 0
        while n < min(len(talk), len(other)) and talk[n] == other[n]:
            n += 1
        assert got[i].prompt_turns == n and got[i].prompt == rendered(talk[:n])[0]
        assert (got[i].chosen, got[i].chosen_mask) == rendered(talk[n:]) and (got[i].rejected, got[i].rejected_mask) == rendered(other[n:])
    assert chat.swapped_answers(spark.createDataFrame([], schema)).count() == 0


# 5


def brute_scan(files, idf_docs):
    """Own licence of each file: every line and the whole text against every template."""
    import math

    counted = [(n, Counter(licenses.terms_of(t))) for n, t in licenses.TEMPLATES]
    known = {w for _, c in counted for w in c}
    held = [{w if w in known else licenses._OTHER for w in licenses.terms_of(t or "")} for t in idf_docs]
    idf = {w: math.log((1 + len(held)) / (1 + sum(w in h for h in held))) + 1 for w in known | {licenses._OTHER}}
    out = []
    for text in files:
        best = None
        for unit in [*(text or "").split("\n"), text or ""]:
            tf = Counter(w if w in known else licenses._OTHER for w in licenses.terms_of(unit))
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
            for name, c in counted:
                dot = sum(tf[w] * n * idf[w] ** 2 for w, n in c.items())
                size = norm * math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
                cos = round(dot / size, 6) if size else 0
                if cos >= licenses.LINE_COSINE and (best is None or (-cos, name) < best):
                    best = (-cos, name)
        out.append(best)
    return out


def test_license_lines_brute_force(spark, documents):
    rows = documents.collect()
    got = {r.doc_id: r for r in licenses.scan(documents.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))).collect()}
    want = brute_scan([r.text for r in rows], [r.text for r in rows])
    assert any(want)
    for r, w in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.how == "own") == (w is not None)
        if w:
            assert g.license == w[1] and abs(g.cosine + w[0]) < 2e-6


def test_license_inheritance(spark, none):
    mit, filler = "Released under the MIT License.", "some words of code and so on with no terms at all here"
    files = [(1, "a/LICENSE", mit), (2, "a/b/c.py", filler), (3, "a/b/d/LICENSE", "Licensed under the Apache License, Version 2.0"), (4, "a/b/d/e/f.py", filler), (5, "z/f.py", filler), (6, "ab/f.py", filler), (7, None, None), (8, "a/own.py", f"x\n{'Licensed under CC BY-NC 4.0.'}\n" + filler), (2, "a/b/c.py", filler)]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string").withColumns({"license": F.lit("clash"), "n": F.lit(1)})
    got = Counter((r.doc_id, r.license, r.how, r.from_dir) for r in licenses.scan(frame).collect())
    assert got == Counter({(1, "MIT", "own", None): 1, (2, "MIT", "inherited", "a"): 2, (3, "Apache-2.0", "own", None): 1, (4, "Apache-2.0", "inherited", "a/b/d"): 1, (5, None, "none", None): 1, (6, None, "none", None): 1, (7, None, "none", None): 1, (8, "CC-BY-NC-4.0", "own", None): 1})
    assert licenses.scan(none.withColumn("path", F.lit("a"))).count() == 0


def test_license_marks_outside_ascii(spark):
    """Every character but a-z, 0-9 and inner dots ends a term, against a splitter of its own."""

    def split(text):
        out, word, text = [], "", text.lower()
        for i, c in enumerate(text):
            if c in "abcdefghijklmnopqrstuvwxyz0123456789" or (c == "." and text[i + 1 : i + 2] in tuple("0123456789")):
                word += c
            else:
                out.append(word)
                word = ""
        return [w for w in [*out, word] if w]

    notices = {"\u201cAll rights reserved\u201d": "Proprietary", "Licensed under the Apache\xa0License, Version\xa02.0": "Apache-2.0", "MIT\xa0License": "MIT", "Licensed under CC BY\u2011NC 4.0": "CC-BY-NC-4.0", "\xabReleased\u2014under\x0bthe\x0cMIT\u2003License\xbb": "MIT", "Stra\xdfe 1.5. v.2 .5 \U0001f600x\x00y\x7fz \u0130\u212a": None}
    filler = [f"some words of code number {i}" for i in range(40)]
    frame = spark.createDataFrame([(i, f"d{i}/f.txt", t) for i, t in enumerate([*notices, *filler])], "doc_id long, path string, text string")
    assert all(r.w == split(r.text) for r in frame.select("text", F.expr(licenses._terms("lower(text)")).alias("w")).collect())
    assert all(licenses.terms_of(t) == split(t) for t in notices)
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert [got[i].license for i in range(len(notices))] == list(notices.values())
    assert all(got[i].cosine == 1.0 for i in (0, 1, 3, 4))


def test_license_of_odd_rows(spark, odd_rows, none):
    """A row for each file, whatever its text: null, empty, very long, repeated; ids may be null, columns may clash."""
    long = " ".join(t or "" for _, t in odd_rows) + " Released under the MIT License " + "word " * 20_000
    files = [(i, f"a/{k}.txt", t, "clash", 0.5, 1) for k, (i, t) in enumerate(odd_rows)] + [(99, "b/x.txt", long, "clash", 0.5, 1), (98, None, "MIT License", "clash", 0.5, 1)]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string, license string, cosine double, key int")
    got = licenses.scan(frame).collect()
    assert Counter(r.doc_id for r in got) == Counter(f[0] for f in files)
    assert {r.license for r in got if r.doc_id == 99} == {"MIT"}
    assert licenses.scan(spark.createDataFrame([], frame.schema)).count() == 0


def test_license_windows_and_texts(spark):
    """Notices inside longer lines and over line breaks against every window; a licence's text speaks for its directory."""
    import math

    random.seed(5)
    noise = lambda n: " ".join(random.choice("foo bar baz module toolkit parse value table row page".split()) for _ in range(n))
    mit = (licenses.FULL_TEXTS / "MIT.txt").read_text()
    gpl = (licenses.FULL_TEXTS / "GPL-3.0.txt").read_text()
    texts = [
        "This module is part of the Foo toolkit by Jane Doe and contributors. It is released under the MIT License. See the project page for details and support.",
        "Copyright 2019 to 2024 by Foo Bar Incorporated and its many partners and subsidiaries worldwide, all rights reserved.",
        f"{noise(30)} licensed under the\n\n  Apache License,\nVersion 2.0 {noise(40)}",
        f"{noise(20)} MIT {noise(20)} and the license of {noise(20)} all about rights {noise(9)}",
        f"{noise(15)} Redistribution and use in source and binary forms, with or without modification,\nare permitted {noise(15)}",
        "see the project page\nReleased under this\nMIT License for all",
        "All rights", "", *(noise(25) for _ in range(20)),
    ]
    counted = [(n, Counter(licenses.terms_of(t))) for n, t in licenses.TEMPLATES]
    known = {w for _, c in counted for w in c}
    files = [*texts, f"Copyright 2021 Jane Doe\n\n{mit}", noise(10), gpl, noise(11)]
    held = [{w if w in known else "*" for w in licenses.terms_of(t)} for t in files]
    idf = {w: math.log((1 + len(held)) / (1 + sum(w in h for h in held))) + 1 for w in known | {"*"}}

    def best(text):
        lines = [x for x in map(licenses.terms_of, text.split("\n")) if x]
        all_terms = [w for x in lines for w in x]
        units = [(u, None) for u in [*lines, *(a + b for a, b in zip(lines, lines[1:])), all_terms]]
        units += [(all_terms[i : i + m], m) for m in {c.total() for _, c in counted} for i in range(len(all_terms) - m + 1)]
        found = []
        for unit, m in units:
            tf = Counter(w if w in known else "*" for w in unit)
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
            for name, c in counted:
                size = norm * math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
                cos = round(sum(tf[w] * n * idf[w] ** 2 for w, n in c.items()) / size, 6) if size else 0
                if cos >= (0.6 if m is None else 0.85) and m in (None, c.total()):
                    found.append((-cos, name))
        return min(found, default=None)

    n = len(texts)
    paths = [f"d{i}/f.txt" for i in range(n)] + ["m/about.txt", "m/sub/x.py", "g/terms.txt", "g/y.py"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(zip(range(n + 4), paths, files)), "doc_id long, path string, text string")).collect()}
    for i, text in enumerate(texts):
        want = best(text)
        assert got[i].license == (want and want[1]) and (not want or abs(got[i].cosine + want[0]) < 2e-6), (i, got[i], want)
    assert [got[i].license for i in (0, 1, 2, 3, 4)] == ["MIT", "Proprietary", "Apache-2.0", None, "BSD-3-Clause"]
    assert [(got[i].license, got[i].how, got[i].from_dir) for i in range(n, n + 4)] == [("MIT", "own", None), ("MIT", "inherited", "m"), ("GPL-3.0", "own", None), ("GPL-3.0", "inherited", "g")]


# 6


def brute_contamination(docs, items, span=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = []
    for i, t in items:
        w = words(t)
        m = min(span, len(w))
        windows += [(i, w[k : k + m]) for k in range(len(w) - m + 1)] if w else []
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_winnowing_brute_force(spark, odd, odd_rows, none):
    random.seed(9)
    vocabulary = ["a", "B", "c1", "é", "D"]
    line = lambda n: " ".join(random.choices(vocabulary, k=n))
    items = [(k, line(n)) for k, n in enumerate([3, 9, 10, 11, 25, 40, 1])] + [(7, None), (8, "..."), (None, "one two three"), (4, "ONE-two_three")]
    docs = odd_rows + [(100 + k, ", ".join([line(30), items[random.randint(0, 6)][1], line(5)])) for k in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    want = brute_contamination(docs, items)
    for limit in (winnow.INDEX_BYTES, 60):
        rows = winnow.decontaminate(frame, benchmark, index_bytes=limit).collect()
        assert Counter(tuple(r) for r in rows) == want
        kept = winnow.clean_only(frame, benchmark, index_bytes=limit).collect()
        assert Counter(r.doc_id for r in kept) == Counter(w[0] for w in want.elements() if not w[5])
    assert not any(r.contaminated for r in winnow.decontaminate(odd, benchmark.limit(0)).collect())
    assert winnow.decontaminate(none, benchmark).count() == 0


def test_winnowing_of_repeats(spark):
    items = [("one", "a " * 300), ("two", "a b " * 60), ("short", "a a b"), ("one", "a " * 300), ("three", "x " + "a " * 9 + "y")]
    docs = [(1, "a " * 500), (2, "b a " * 100), (3, "a " * 9), (4, "x " + "a " * 9 + "y " + "a " * 9), (5, "a a a b " * 30)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert Counter(tuple(r) for r in winnow.decontaminate(frame, benchmark).collect()) == brute_contamination(docs, items)
    # 20,000 equal words against 5,000 of them: the work is in proportion to the words, not to pairs of places.
    began = time.time()
    index = winnow.Index([("x", b"a " * 5000)])
    hit, found = index.search(winnow.Words([b"a " * 20_000], index.known))
    assert hit.all() and found == {0: {0}} and time.time() - began < 2


# 7


def test_quality_held_out(spark, none, odd):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    assert quality.score(none, labels).count() == 0 and {r.score for r in quality.score(odd, labels.limit(0)).collect()} == {0.5}
    scored = quality.score(odd, labels.withColumn("doc_id", F.col("doc_id") % 10)).collect()
    assert len(scored) == odd.count() and len({r.score for r in scored if r.doc_id == 5}) == 1
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_quality_votes_brute_force(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    chosen = documents.select("doc_id", "text")
    model = quality.fit(chosen, labels)
    texts = [r.text.encode() for r in chosen.limit(40).collect()]
    for t, got in zip(texts, quality.score_block(model, texts), strict=True):
        x = quality.terms_of([t])[0] * model["idf"]
        x = x / np.linalg.norm(x) @ model["projection"]
        cos = model["vectors"] / quality._FINE @ (x / np.linalg.norm(x))
        near = sorted(range(len(cos)), key=lambda k: -cos[k])[: quality.NEIGHBOURS]
        w = [max(float(cos[k]), 1e-6) ** quality.SHARPNESS * model["vote"][k] for k in near]
        assert abs(got - sum(v for v, k in zip(w, near, strict=True) if model["y"][k] == 1) / sum(w)) < 1e-3


def test_quality_scores_do_not_depend_on_blocks(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = [sorted((r.doc_id, r.score) for r in quality.score(documents.repartition(n, F.xxhash64("doc_id")), labels).collect()) for n in (1, 7)]
    assert seen[0] == seen[1]
    model = quality.fit(documents.select("doc_id", "text"), labels)
    texts = [r.text.encode() for r in documents.limit(60).collect()]
    assert quality.score_block(model, texts).tolist() == [quality.score_block(model, [t])[0] for t in texts]


def test_quality_ties_go_to_the_earlier_vector(spark, documents):
    model = quality.fit(documents.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    equal = np.repeat(model["vectors"][:1], 6, axis=0)
    for y, want in (([1, 0, 0, 0, 1, 1], 1 / 3), ([0, 0, 0, 1, 1, 1], 0), ([1, 1, 1, 0, 0, 0], 1)):
        held = model | {"vectors": equal, "y": np.array(y), "vote": np.ones(6)}
        assert abs(quality.score_block(held, [b"one two three"], neighbours=3)[0] - want) < 1e-12


# 8


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = {f: f for _, f in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = list(parent)
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return Counter((i, f"{f:016x}", least.get(root(f))) for i, f in rows)


def test_simhash_brute_force(spark, documents, odd, odd_rows, none):
    for docs, rows in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (odd, odd_rows)):
        want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_representatives(documents)
    heads = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(heads)
    assert Counter(r.doc_id for r in simhash.keep_representatives(odd).collect())[5] <= 1


def test_fingerprints_do_not_depend_on_how_many_shingles_are_held(odd_rows):
    texts = [(t or "").encode() for _, t, *_ in odd_rows] + [b"", b" ", b"a", b"a b c d", b"a b c d e", b"x y z " * 5000]
    whole = simhash.fingerprint_block(texts)
    for most in (1, 7, 1000):
        assert (simhash.fingerprint_block(texts, most=most) == whole).all()
    assert len(simhash.fingerprint_block([])) == 0


def test_representatives_of_clashing_ids(spark):
    random.seed(12)
    one, two, three = (" ".join(random.choice("abcdefghij") + str(random.randint(0, 999)) for _ in range(80)) for _ in range(3))
    rows = [(5, one), (5, two), (5, three), (5, two), (2, three), (7, one), (8, "x y"), (None, one)]
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(5, one), (5, two), (2, three), (8, "x y"), (None, one)])


def test_links_lose_none(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(25)]
    near = [b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 6))) for b in base for _ in range(12)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    want = {int(f, 16): c for _, f, c in brute_components([(k, x & (1 << 64) - 1) for k, x in enumerate(signed)])}
    groups = {}
    for x in signed:
        groups.setdefault(want[x & (1 << 64) - 1], set()).add(x)
    assert all(len({got.get(x, x) for x in g}) == 1 for g in groups.values()) and len({got.get(x, x) for x in signed}) == len(groups)


def test_components_of_a_path_and_nothing(spark):
    path = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (5, 5), (None, 1)], "a long, b long")
    assert {(r.node, r.component) for r in components(path).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    assert components(path.limit(0)).count() == 0


def test_tables_of_components_have_as_many_files_as_their_rows_need(spark, monkeypatch):
    """A file for each of a shuffle's partitions makes thousands of files of a few rows, each with programs started by the executor."""
    import stratum.llm.components
    from stratum import runtime

    seen = []

    def counted(*args, **kwargs):
        out = runtime.settle(*args, **kwargs)
        seen.append((out.count(), len(out.inputFiles())))
        return out

    monkeypatch.setattr(stratum.llm.components, "settle", counted)
    monkeypatch.setattr(runtime, "FILE_ROWS", 50, raising=False)
    random.seed(13)
    order = random.sample(range(60), 60)
    edges = list(zip(order, order[1:], strict=False)) + [(200, k) for k in range(300, 400)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert found == {k: 0 for k in range(60)} | {k: 200 for k in (200, *range(300, 400))}
    # The first table's rows are not known before; of a later one at most twice the edges can come.
    assert seen[0] == (159, 16) and len(seen) > 3 and all(files <= 7 for _, files in seen[1:]) and any(files > 1 for _, files in seen[1:])


def test_join_to_one_keeps_hot_keys_without_a_row(spark):
    facts = spark.createDataFrame([("h", k) for k in range(50)] + [("x", 1), (None, 2)], "k string, v int")
    counts = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for dims in ([("x", 7)], [("h", 8), ("x", 7)]):
        out = join_to_one(facts, spark.createDataFrame(dims, "k string, d int"), hot_keys(counts, "k"), "k").collect()
        assert len(out) == 52 and all(r.d == dict(dims).get(r.k) for r in out)


# 9


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_tokenizer())
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_equal_the_library(documents):
    random.seed(8)
    letters = "abc  .,'\n\t12é漢_$- \u0085sST\u00a0\u2003\u3000\x00\x1c(|>"
    texts = [r.text for r in documents.collect()] + ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(3000)]
    texts += [" ".join(t.split()) for t in texts[-2000:]] + ["don't it's 'll", "<|endoftext|> x", "a<|endoftext|>", "<|endoftext", " lead", "trail ", "ǅa ªb", "", "a" * 40 + ",", "one,two... three?!"]
    for most in (bpe.MOST_KEPT, 100):
        encoder = bpe.WordEncoder(bpe.default_tokenizer())
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(bpe, "MOST_KEPT", most)
            patch.setattr(bpe, "MOST_RECENT", 50)
            stream, counts = encoder.encode([t.encode() for t in texts])
        got = np.split(stream, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == library_ids(texts)
        assert all(encoder.token_sizes()[x].sum() == len(t.encode()) for x, t in zip(got, texts, strict=True))


def test_store_round_trip(spark, tmp_path, odd, odd_rows, none):
    path = str(tmp_path / "store")
    idstore.write_store(odd, path)
    ids = [[*x, 2] for x in library_ids([t or "" for _, t in odd_rows])]
    rows = sorted(idstore.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id is not None for r in rows] == [False] + [True] * (len(rows) - 1)
    assert [r.doc_id for r in rows[1:]] == sorted(i for i, _ in odd_rows if i is not None)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(odd_rows, ids, strict=True))
    back = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in idstore.read_ids(spark, path).collect()}
    assert all(back[i] == x for (i, _), x in zip(odd_rows, ids, strict=True))
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("name").distinct().count()
    idstore.write_store(none, str(tmp_path / "empty"))
    assert idstore.read_documents(spark, str(tmp_path / "empty")).count() == 0


def test_store_of_special_tokens_and_copies(spark, tmp_path):
    texts = [(5, "<|endoftext|> x"), (3, "a\nb"), (5, "<|endoftext|> x"), (4, "<|endoftext|> x"), (None, None), (None, None)]
    path = str(tmp_path / "store")
    idstore.write_store(spark.createDataFrame(texts, "doc_id long, text string"), path)
    rows = sorted(idstore.read_documents(spark, path).collect(), key=lambda r: r.start)
    want = [(i, [*library_ids([t or ""])[0], 2]) for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0))]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    assert [50256, 2124, 2] in [x for _, x in want]
    assert Counter((r.doc_id, r.ids) for r in idstore.read_ids(spark, path).collect()) == Counter((i, np.array(x, "<u2").tobytes()) for i, x in want)


DAMAGES = {
    "name": lambda x: x.withColumn("name", F.when(F.col("row") == 1, F.unhex(F.lit("00" * 16))).otherwise(F.col("name"))),
    "doc_id": lambda x: x.withColumn("doc_id", F.col("doc_id") + 7),
    "start": lambda x: x.withColumn("start", F.col("start") + 5),
    "copies": lambda x: x.withColumn("copies", F.when(F.col("row") == 2, 2).otherwise(F.col("copies")).cast("long")),
    "rows": lambda x: x.where("row <> 3"),
    "all rows": lambda x: x.limit(0),
    "twice": lambda x: x.unionByName(x),
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory, documents):
    path = tmp_path_factory.mktemp("stores") / "store"
    idstore.write_store(documents.limit(20), str(path))
    return path


@pytest.mark.parametrize("kind", sorted(DAMAGES))
def test_store_tells_damage_of_its_index(spark, tmp_path, store, kind):
    shutil.copytree(store, tmp_path / "store")
    shutil.rmtree(tmp_path / "store" / "index")
    DAMAGES[kind](idstore._index(spark, str(store))).write.parquet(str(tmp_path / "store" / "index"))
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_documents(spark, str(tmp_path / "store"))


def test_store_tells_a_lost_manifest(spark, tmp_path, store):
    shutil.copytree(store, tmp_path / "store")
    shutil.rmtree(tmp_path / "store" / "manifest")
    spark.read.parquet(f"{store}/manifest").limit(0).write.parquet(str(tmp_path / "store" / "manifest"))
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_documents(spark, str(tmp_path / "store"))


@pytest.mark.parametrize("kind,change", [("recipe", "lost"), ("chunk", "lost"), ("recipe", "other"), ("chunk", "other")])
def test_store_tells_damaged_objects(spark, tmp_path, store, kind, change):
    shutil.copytree(store, tmp_path / "store")
    shutil.rmtree(tmp_path / "store" / "objects" / f"kind={kind}")
    schema = "name binary, doc_id long, n long, copies long, payload binary"
    objects = spark.read.schema(schema).parquet(f"{store}/objects/kind={kind}")
    least = objects.agg(F.min("name")).first()[0]
    if change == "lost":
        objects = objects.where(F.col("name") != F.lit(least))
    else:
        objects = objects.withColumn("payload", F.when(F.col("name") == F.lit(least), F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.unhex(F.lit("EE")))).otherwise(F.col("payload")))
    objects.write.parquet(str(tmp_path / "store" / "objects" / f"kind={kind}"))
    with pytest.raises(Exception, match="no recipe|not stored|other bytes"):
        idstore.read_documents(spark, str(tmp_path / "store")).collect()


def test_crc_of_parts():
    rng = np.random.default_rng(3)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 5000, (50, 2))]
    got = idstore.crc32_joined(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([zlib.crc32(b) for _, b in parts], np.uint32), np.array([len(b) for _, b in parts]), idstore._crc_tables())
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


# 10


@pytest.mark.parametrize("rule", ["first", "most"])
def test_section_tokens_brute_force(spark, odd, odd_rows, none, rule):
    rows = token_counts.section_tokens(odd, rule=rule).collect()
    encoder = bpe.WordEncoder.at(bpe.default_tokenizer())
    want = Counter()
    for i, t in odd_rows:
        raw = (t or "").encode()
        sections = [x for x in re.split(rb"(?<=\n)", raw) if x] or [b""]
        owner = [k for k, s in enumerate(sections) for _ in s]
        counts, at = Counter(), 0
        ids = library_ids([t or ""])[0]
        for token in ids:
            over = owner[at : at + int(encoder.token_sizes()[token])]
            at += len(over)
            counts[over[0] if rule == "first" else min(set(over), key=lambda k: (-over.count(k), k))] += 1
        for k, s in enumerate(sections):
            want[i, k, len(s), len(s.decode()), counts[k], len(ids)] += 1
    assert Counter((r.doc_id, r.section, r.end_byte - r.begin_byte, r.end_char - r.begin_char, r.n_tokens, r.doc_tokens) for r in rows) == want
    assert token_counts.section_tokens(none).count() == 0


def test_section_tokens_of_given_sections_and_fields(spark):
    texts = ["é漢字 one two", "abc", "", None, "<|endoftext|> x"]
    begins = [[3, 3, 99, 1, -1, None], [], None, [1], [2, 14]]
    docs = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(zip(texts, begins, strict=True))], "doc_id long, text string, at array<int>")
    rows = token_counts.section_tokens(docs, begins_col="at").orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.begin_char, r.end_char) for r in rows] == [(0, 0, 1), (0, 1, 3), (0, 3, 11), (1, 0, 3), (2, 0, 0), (3, 0, 0), (4, 0, 2), (4, 2, 14), (4, 14, 15)]
    for i, t in enumerate(texts):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == len(library_ids([t or ""])[0])
    fields = spark.createDataFrame([(1, "a title", None, "the body"), (2, None, None, None)], "doc_id long, title string, head string, text string")
    rows = token_counts.field_tokens(fields, ["title", "head", "text"]).orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.begin_char, r.end_char) for r in rows] == [(1, 0, 8), (1, 8, 9), (1, 9, 17), (2, 0, 1), (2, 1, 2)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == len(library_ids(["a title\n\nthe body"])[0])


# All of them


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = docs
    wants = []
    held = {r.doc_id: r.text for r in docs.collect()}
    accepted = {r.doc_id for r in quality.score(docs, labels).collect() if r.predicted}
    held = {i: t for i, t in held.items() if i in accepted}
    wants.append(set(held))
    heads = {c for _, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in held.items()])}
    held = {i: t for i, t in held.items() if i in heads}
    wants.append(set(held))
    dirty = {w[0] for w in brute_contamination(list(held.items()), [(r.item_id, r.text) for r in items.collect()]) if w[5]}
    wants.append(set(held) - dirty)
    for (_, stage), want in zip(corpus_pipeline.STAGES, wants, strict=False):
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == wants[-1] and all(r.round_trip for r in rows)
    assert kept.where("doc_id < 0").count() == 0


def test_pipeline_stages_of_odd_tables(spark, odd_rows):
    """Each stage takes null, empty, long and repeated rows with columns of clashing names, and no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, __x int"
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.5, 2, 3) for i, t in odd_rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert got.columns == docs.columns
            assert not {(r.doc_id, r.text) for r in got.collect()} - set(odd_rows)
        else:
            assert got.count() == len(odd_rows)
        assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    heads = {c for i, _, c in brute_components([(i, brute_fingerprint(t or "")) for i, t in odd_rows if i is not None])}
    assert {i for i in ids if i is not None} == heads


def test_registry_covers_all_dealt():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
