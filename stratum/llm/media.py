"""AVI motion-JPEG: writing, index parsing, intra-frame decoding and shot detection.

Frames are JPEG images, each decoded by itself: lossless ones (process 14, predictor 1, one 8-bit
component) and baseline ones of one component; a baseline frame without tables of its own has the
standard's. All frames of a block that share a header are decoded in step: each step reads one Huffman
symbol of every frame through a table that is indexed by the next 16 bits. A RIFF file's ``idx1`` index
says where the frames are; a file without one is walked, with its ``rec `` lists, and so are the further
parts of a file in several (``AVIX``). Of several video streams the first counts.

Shots: histograms of neighbouring frames differ by half their absolute difference; a cut is where that
exceeds both ``FLOOR`` and the mean plus ``SIGMAS`` deviations of the ``HISTORY`` differences before it
since the last cut.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import map_arrow
from stratum.sources.tables import table

SIDE = 24
FRAME_BYTES = SIDE * SIDE
#: Samples whose frames are encoded or decoded at once; a sample takes about 120 bytes of arrays.
SLICE_SAMPLES = 1 << 20
FPS = 25
BINS = 16
HISTORY, SIGMAS, FLOOR = 8, 3.0, 0.15
#: Code lengths 1 to 16 and symbols of the standard's luminance DC table; they serve differences of lossless frames.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: Code lengths 1 to 16 and symbols of the standard's luminance AC table.
AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"
    "090a161718191a25262728292a3435363738393a434445464748494a535455565758595a"
    "636465666768696a737475767778797a838485868788898a92939495969798999a"
    "a2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
    "e1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def _codes(counts: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> dict[int, tuple[int, int]]:
    """Canonical Huffman: symbol to code and length."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, start=1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _peek_table(counts: tuple[int, ...] | bytes, symbols: tuple[int, ...] | bytes) -> np.ndarray:
    """For any next 16 bits: symbol * 32 + length of the code they start with; length 0: none."""
    out = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(counts, symbols).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = symbol * 32 + length
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head(width: int, height: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xC3, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
            _segment(0xDA, struct.pack(">B2B3B", 1, 1, 0x00, 1, 0, 0)),
        ]
    )


def _slices(n: int, samples: int) -> Iterator[slice]:
    """Frames of ``samples`` each, in slices of about SLICE_SAMPLES: frames don't depend on one another, so a long file takes no more memory for its arrays than a short one."""
    step = max(1, SLICE_SAMPLES // max(samples, 1))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """Lossless JPEG of 8-bit frames [frame, row, column]."""
    return [coded for at in _slices(len(frames), frames[0].size if len(frames) else 0) for coded in _encode_slice(frames[at])]


def _encode_slice(frames: np.ndarray) -> list[bytes]:
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    diff[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    diff[:, 0, 0] = x[:, 0, 0] - 128
    diff = diff.reshape(n, -1).astype(np.int64)
    size = np.zeros(256 * 2, np.int64)
    size[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int64) + 1
    table_of = _codes(DC_COUNTS, DC_SYMBOLS)
    code = np.array([table_of[s][0] for s in range(12)])
    length = np.array([table_of[s][1] for s in range(12)])
    s = size[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
    value, bits = (code[s] << s) | extra, length[s] + s
    ends = np.cumsum(bits, axis=1)
    total = (ends[:, -1] + 7) // 8
    base = np.cumsum(total) - total
    at = (ends - bits) + base[:, None] * 8
    shifted = value << (24 - bits - (at & 7))
    place = (at >> 3).ravel()
    room = int(total.sum()) + 3
    out = np.zeros(room, np.int64)
    for k in range(3):
        out += np.bincount(place + k, weights=((shifted >> (16 - 8 * k)) & 255).ravel(), minlength=room).astype(np.int64)
    pad = (8 - (ends[:, -1] & 7)) & 7
    out[base + total - 1] |= (1 << pad) - 1
    raw = out.astype(np.uint8).tobytes()
    head = _frame_head(width, height)
    return [head + raw[b : b + t].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for b, t in zip(base.tolist(), total.tolist(), strict=True)]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """A RIFF AVI file of one motion-JPEG stream with an index."""
    chunk = lambda tag, body: tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<I2i2H4s5I", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    parts, index, at = [], [], 4
    for frame in frames:
        parts.append(chunk(b"00dc", frame))
        index.append(b"00dc" + struct.pack("<3I", 0x10, at, len(frame)))
        at += len(parts[-1])
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _walk(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    at = start
    while at + 8 <= stop:
        tag, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield tag, at + 8, min(at + 8 + size, stop)
        at += 8 + size + (size & 1)


def _frames_of(data: bytes, start: int, stop: int, tags: set[bytes]) -> Iterator[bytes]:
    """Frames of a list in the order of the file, with those of the ``rec `` lists in it."""
    for tag, a, b in _walk(data, start, stop):
        if tag == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _frames_of(data, a + 4, b, tags)
        elif tag in tags:
            yield data[a:b]


def _streams(data: bytes, start: int, stop: int) -> tuple[float, set[bytes]]:
    """Frames a second, and the chunk tags of the first video stream."""
    fps, number, tags = float(FPS), 0, set()
    for tag, a, b in _walk(data, start, stop):
        if tag == b"avih":
            fps = 1e6 / max(1, int.from_bytes(data[a : a + 4], "little"))
        elif tag == b"LIST" and data[a : a + 4] == b"strl":
            if not tags and any(t == b"strh" and data[c : c + 4] == b"vids" for t, c, _ in _walk(data, a + 4, b)):
                tags = {b"%02ddc" % number, b"%02ddb" % number}
            number += 1
    return fps, tags


def parse_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the first video stream's frames, by the index where there is one. Not an AVI file: ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    fps, tags, index, lists = float(FPS), set(), None, []
    for part, start, stop in _walk(data, 0, len(data)):
        if part != b"RIFF":
            continue
        for tag, a, b in _walk(data, start + 4, stop):
            if tag == b"LIST" and data[a : a + 4] == b"hdrl":
                fps, tags = _streams(data, a + 4, b)
            elif tag == b"LIST" and data[a : a + 4] == b"movi":
                lists.append((a, b))
            elif tag == b"idx1" and index is None:
                index = (a, b)
    if not lists:
        raise ValueError("no frames list")
    tags = tags or {b"00dc", b"00db"}
    frames = []
    if index is not None:
        base, lists = lists[0][0], lists[1:]
        for tag, _, at, size in struct.iter_unpack("<4s3I", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16]):
            if tag in tags:
                start = at + (base if data[base + at : base + at + 4] == tag else 0) + 8
                frames.append(data[start : start + size])
    for a, b in lists:
        frames.extend(_frames_of(data, a + 4, b, tags))
    return fps, frames


@lru_cache(maxsize=1)
def _standard_tables() -> tuple[tuple[int, np.ndarray], ...]:
    """Tables of frames that bring none: luminance DC and AC."""
    return ((0, _peek_table(DC_COUNTS, DC_SYMBOLS)), (16, _peek_table(AC_COUNTS, AC_SYMBOLS)))


class _Head:
    """What a frame's segments before its scan say."""

    def __init__(self, data: bytes):
        self.quant, self.tables = {}, dict(_standard_tables())
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2 or data[at] != 0xFF:
                raise ValueError("a segment is cut short")
            if marker in (0xC0, 0xC3):
                self.lossless = marker == 0xC3
                bits, self.height, self.width, parts = struct.unpack(">BHHB", body[:6])
                if bits != 8 or parts != 1:
                    raise ValueError("only one component of 8 bits")
                self.quant_of = body[8]
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline and lossless frames")
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    self.quant[body[k] & 15] = np.frombuffer(body[k + 1 : k + 65], np.uint8).astype(np.int64)
                    k += 65
            elif marker == 0xC4:
                k = 0
                while k < len(body):
                    counts = body[k + 1 : k + 17]
                    n = sum(counts)
                    self.tables[body[k]] = _peek_table(counts, body[k + 17 : k + 17 + n])
                    k += 17 + n
            elif marker == 0xDD and int.from_bytes(body, "big"):
                raise ValueError("no restart intervals")
            elif marker == 0xDA:
                self.dc, self.ac, self.predictor = body[2] >> 4, body[2] & 15, body[3]
                self.size = at + 2 + size
                return
            at += 2 + size


def _head_size(data: bytes) -> int:
    at = 2
    while at + 4 <= len(data):
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xDA:
            return at + 2 + size
        at += 2 + size
    raise ValueError("no scan")


class _Bits:
    """The scans of many frames, read in step."""

    def __init__(self, scans: list[bytes]):
        clean = [s.replace(b"\xff\x00", b"\xff") for s in scans]
        sizes = np.fromiter(map(len, clean), np.int64, len(clean)) + 8
        flat = np.frombuffer(b"".join([c + b"\xff" * 8 for c in clean]), np.uint8).astype(np.int64)
        self.words = np.zeros(len(flat), np.int64)
        for k in range(4):
            self.words[: len(flat) - k] |= flat[k:] << (24 - 8 * k)
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.stop = np.cumsum(sizes) * 8 - 40

    def symbol(self, table_: np.ndarray, on: np.ndarray) -> np.ndarray:
        at = self.at[on]
        if (at > self.stop[on] + 8).any():
            raise ValueError("a scan is cut short")
        found = table_[(self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        if not (found & 31).all():
            raise ValueError("no such code")
        self.at[on] = at + (found & 31)
        return found >> 5

    def signed(self, size: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Extra bits of a difference or coefficient of that size."""
        at = self.at[on]
        value = (self.words[at >> 3] >> (32 - size - (at & 7))) & ((1 << size) - 1)
        self.at[on] = at + size
        return np.where(value < (1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value) * (size > 0)


def _zigzag() -> np.ndarray:
    """Place of each coefficient in scan order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([8 * r + c for r, c in sorted(cells, key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))])


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _lossless(head: _Head, bits: _Bits, n: int) -> np.ndarray:
    if head.predictor != 1:
        raise ValueError("only predictor 1")
    everyone = np.arange(n)
    diff = np.empty((head.height * head.width, n), np.int64)
    for k in range(len(diff)):
        size = bits.symbol(head.tables[head.dc], everyone)
        diff[k] = bits.signed(size, everyone)
    diff = diff.T.reshape(n, head.height, head.width)
    diff[:, :, 0] = np.cumsum(diff[:, :, 0], axis=1) + 128
    return (np.cumsum(diff, axis=2) & 255).astype(np.uint8)


def _baseline(head: _Head, bits: _Bits, n: int) -> np.ndarray:
    rows, cols = -(-head.height // 8), -(-head.width // 8)
    coefficients = np.zeros((n, rows * cols, 64))
    everyone, last = np.arange(n), np.zeros(n, np.int64)
    quant = head.quant[head.quant_of]
    for block in range(rows * cols):
        last = last + bits.signed(bits.symbol(head.tables[head.dc], everyone), everyone)
        coefficients[:, block, 0] = last * quant[0]
        place = np.ones(n, np.int64)
        while (live := np.flatnonzero(place < 64)).size:
            symbol = bits.symbol(head.tables[16 + head.ac], live)
            run, size = symbol >> 4, symbol & 15
            value = bits.signed(size, live)
            ended = (size == 0) & (run != 15)
            place[live] += np.where(ended, 64, run)
            keep = ~ended & (place[live] < 64)
            on = live[keep]
            coefficients[on, block, _ZIGZAG[place[on]]] = value[keep] * quant[place[on]]
            place[on] += 1
    pixels = np.einsum("ux,nbuv,vy->nbxy", _COSINES, coefficients.reshape(n, -1, 8, 8), _COSINES, optimize=True)
    whole = np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8)
    return whole.reshape(n, rows, cols, 8, 8).swapaxes(2, 3).reshape(n, rows * 8, cols * 8)[:, : head.height, : head.width]


def decode_frames(frames: list[bytes]) -> list[np.ndarray | None]:
    """The samples of each frame; None for one that can't be decoded."""
    groups: dict[bytes, list[int]] = defaultdict(list)
    out: list[np.ndarray | None] = [None] * len(frames)
    for i, frame in enumerate(frames):
        try:
            groups[frame[: _head_size(frame)]].append(i)
        except (ValueError, IndexError):
            continue
    for raw, members in groups.items():
        try:
            head = _Head(raw)
        except (ValueError, IndexError, KeyError):
            continue
        decode = _lossless if head.lossless else _baseline
        for at in _slices(len(members), head.width * head.height):
            held = members[at]
            scans = [frames[i][len(raw) : -2] for i in held]
            try:
                for i, x in zip(held, decode(head, _Bits(scans), len(held)), strict=True):
                    out[i] = x
            except (ValueError, KeyError):
                for i, scan in zip(held, scans, strict=True):  # one of them is damaged: each by itself
                    try:
                        out[i] = decode(head, _Bits([scan]), 1)[0]
                    except (ValueError, KeyError):
                        continue
    return out


def cuts_of(histograms: np.ndarray) -> list[int]:
    """First frames of the shots after the first, from normalised histograms."""
    apart = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2
    cuts, since = [], 0
    for k, d in enumerate(apart.tolist()):
        past = apart[max(since, k - HISTORY) : k]
        if d > FLOOR and (not len(past) or d > past.mean() + SIGMAS * past.std()):
            cuts.append(k + 1)
            since = k + 1
    return cuts


def shots_of(frames: list[np.ndarray | None], fps: float) -> list[dict]:
    """Timed clips: first and end frame, seconds, mean brightness. Frames that can't be decoded belong to the shot before."""
    good = [i for i, f in enumerate(frames) if f is not None]
    if not good:
        return []
    histograms = np.stack([np.bincount(frames[i].ravel() // (256 // BINS), minlength=BINS) / frames[i].size for i in good])
    means = np.array([frames[i].mean() for i in good])
    starts = [0, *cuts_of(histograms), len(good)]
    out = []
    for a, b in zip(starts, starts[1:], strict=False):
        first, end = (good[a] if a else 0), (good[b] if b < len(good) else len(frames))
        out.append({"clip": len(out), "first_frame": first, "end_frame": end, "begin_s": first / fps, "end_s": end / fps, "brightness": round(float(means[a:b].mean()), 3)})
    return out


def payload_of(text: bytes) -> bytes:
    """The text padded with bytes 255 to a positive multiple of FRAME_BYTES."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME_BYTES)) * FRAME_BYTES - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fps: int = FPS) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an AVI file whose frames' samples are its bytes. Null counts as empty; repeated rows each get a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", 1 << 20):
            payloads = [payload_of(t) for t in texts]
            frames = encode_frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE, SIDE))
            media, at = [], 0
            for payload in payloads:
                n = len(payload) // FRAME_BYTES
                media.append(write_avi(frames[at : at + n], SIDE, SIDE, fps))
                at += n
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, "doc_id long, n_bytes long, media binary")


def _decoded(media: list[bytes | None]) -> list[tuple[float, list[np.ndarray | None]]]:
    """Frames a second and decoded frames of each file; of no file or one that isn't AVI, none."""
    parsed = []
    for data in media:
        try:
            parsed.append(parse_avi(data or b""))
        except (ValueError, struct.error):
            parsed.append((float(FPS), []))
    flat = decode_frames([f for _, frames in parsed for f in frames])
    out, at = [], 0
    for fps, frames in parsed:
        out.append((fps, flat[at : at + len(frames)]))
        at += len(frames)
    return out


def clips(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot of each AVI file: (doc_id, clip, first_frame, end_frame, begin_s, end_s, brightness). Null, empty and damaged files give none."""
    fields = "doc_id long, clip int, first_frame long, end_frame long, begin_s double, end_s double, brightness double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, media in blocks(batches, "media", 1 << 20):
            rows = [(doc_id, *shot.values()) for doc_id, (fps, frames) in zip(part.column(0).to_pylist(), _decoded(media), strict=True) for shot in shots_of(frames, fps)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return map_arrow(files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), run, fields)


def digest_media(files: DataFrame) -> DataFrame:
    """The payload read back from each file's decoded frames, with digests and a feature string: frames, shots, brightness and first frames of all shots."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, media in blocks(batches, "media", 1 << 20):
            rows = []
            for data, (fps, frames) in zip(media, _decoded(media), strict=True):
                payload = b"".join([f.tobytes() for f in frames if f is not None])
                shots = shots_of(frames, fps)
                feature = f"frames={len(frames)};shots={len(shots)};brightness={','.join(str(s['brightness']) for s in shots)};starts={','.join(str(s['first_frame']) for s in shots)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], [f.split()[0] for f in fields.split(", ")])

    return map_arrow(files.select("doc_id", "n_bytes", "media"), run, fields)


def op1_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_media(to_media(table(spark, sf_dir, "documents")))
