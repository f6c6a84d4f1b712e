"""SentencePiece encoding and decoding by a batched numpy Viterbi.

Words are cut wherever no piece holds the two neighbouring characters, which no segmentation can
cross. Words of one length advance together: at each end position the hashes of the substrings that
end there probe the sorted hashes of the pieces, and a vectorised maximum over the candidates stores
a back pointer. For unigram models the maximum is that of the summed scores. For BPE models the
merges' result is found by the same recursion with one more condition: a candidate counts only if
the merges of the piece before it and of itself leave the border between them, which is so for
exactly one candidate at each position. Where two ways of a unigram model have equal scores, the
rounding of sums over a whole text may prefer the other one than the sums over a word do here. Characters without a piece become their bytes' pieces.

Distinct words are encoded once and looked up from then on, in a table kept by the worker.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.common import blocks
from stratum.runtime import map_arrow
from stratum.sources.tables import table

MOST_KEPT = 500_000
BATCH_WORDS = 20_000
_SPACE = "▁"
_RUNS = re.compile(f"{_SPACE}*[^{_SPACE}]*")
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """The pieces of a model file, and the table of words encoded so far."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        self.bpe = spec.trainer_spec.model_type == _BPE
        if spec.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation")
        self.prefix = norm.add_dummy_prefix
        kinds = [p.type for p in spec.pieces]
        self.pieces = [p.piece for p in spec.pieces]
        self.scores = np.array([p.score for p in spec.pieces], np.float32)
        self.unknown = kinds.index(_UNKNOWN)
        self.bytes_of = [b"" if k in (_CONTROL, _UNKNOWN) else bytes([int(p[3:-1], 16)]) if k == _BYTE else p.replace(_SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.byte_ids = {self.bytes_of[i][0]: i for i, k in enumerate(kinds) if k == _BYTE}
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        self.id_of = {self.pieces[i]: i for i in normal}
        self.longest = max(map(len, self.id_of))
        hashes = np.array([self._hash(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(normal, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        pairs = {(a, b) for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.sort(np.array([(ord(a) << 32) | ord(b) for a, b in pairs], np.uint64))
        self.kept: dict[str, bytes] = {}
        if self.bpe:
            self._prepare_merges()

    def _hash(self, piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(_ROLL) + ord(c) + 1) % (1 << 64)
        return value

    # Merges of a BPE model.

    def _prepare_merges(self) -> None:
        """Rank of each piece, both sides of its last merge and the chains of its right and left ends."""
        # Pieces of equal score (runs of spaces) merge leftmost first, which the longer one first gives too.
        order = sorted(self.id_of.values(), key=lambda i: (-self.scores[i], -len(self.pieces[i])))
        n = len(self.pieces)
        self.rank = np.full(n, 1 << 40, np.int64)
        self.rank[order] = np.arange(1, len(order) + 1)
        self.own = np.zeros(n, bool)
        sides: dict[int, tuple[int, int]] = {}
        for i in order:
            merged, last = self._merge(self.pieces[i])
            self.own[i] = merged == [i]
            if self.own[i] and last:
                sides[i] = last
        self._right, self._left = {}, {}
        for i in order:
            for chains, side in ((self._right, 1), (self._left, 0)):
                chain = [i]
                while chain[-1] in sides:
                    chain.append(sides[chain[-1]][side])
                chains[i] = chain
        self.joint = {}
        for i in order:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    self.joint[a, b] = int(self.rank[i])
        self.borders: dict[int, bool] = {}

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids that the merges make of a text whose characters all have pieces, and the last merge's sides."""
        parts, last = list(text), None
        while len(parts) > 1:
            found = [(self.rank[self.id_of[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id_of]
            if not found:
                break
            k = min(found)[1]
            last = (self.id_of.get(parts[k], -1), self.id_of.get(parts[k + 1], -1))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.id_of.get(p, -1) for p in parts], last

    def _border_holds(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's text leave the border: no ends of theirs that are there at one time merge before either goes on."""
        if not (self.own[a] and self.own[b]):
            return False
        if self.pieces[a][-1] == _SPACE:
            return self._merge(self.pieces[a] + self.pieces[b])[0] == [a, b]
        rank, joint = self.rank, self.joint
        never = 1 << 41
        above_x = never
        for x in self._right[a]:
            above_y = never
            for y in self._left[b]:
                z = joint.get((x, y))
                if z is not None and z < above_x and z <= above_y:
                    x_from = rank[x] if len(self.pieces[x]) > 1 else 0
                    y_from = rank[y] if len(self.pieces[y]) > 1 else 0
                    if x_from < above_y and y_from < above_x:
                        return False
                above_y = rank[y]
            above_x = rank[x]
        return True

    def _borders_hold(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * np.int64(len(self.pieces)) + b
        distinct, back = np.unique(key, return_inverse=True)
        known, n = self.borders, len(self.pieces)
        if len(known) > 4 * MOST_KEPT:
            known.clear()
        out = np.empty(len(distinct), bool)
        for i, k in enumerate(distinct.tolist()):
            holds = known.get(k)
            if holds is None:
                holds = known[k] = self._border_holds(k // n, k % n)
            out[i] = holds
        return out[back]

    # The recursion.

    def _viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Ids of words of one length (rows of code points): [word, end] is the piece that ends there on the best way, -1 elsewhere."""
        words, length = chars.shape
        prefix = np.zeros((words, length + 1), np.uint64)
        for i in range(length):
            prefix[:, i + 1] = prefix[:, i] * _ROLL + chars[:, i] + np.uint64(1)
        powers = [np.uint64(1)]
        for _ in range(self.longest):
            powers.append(np.uint64(int(powers[-1]) * int(_ROLL) % (1 << 64)))
        best = np.full((words, length + 1), -np.inf, np.float32)
        best[:, 0] = 0.0
        back = np.zeros((words, length + 1), np.int32)
        piece = np.full((words, length + 1), -1, np.int64)
        for end in range(1, length + 1):
            spans = np.arange(1, min(self.longest, end) + 1)
            keys = prefix[:, end][:, None] - prefix[:, end - spans] * np.array(powers, np.uint64)[spans]
            at = np.minimum(np.searchsorted(self.keys, keys.ravel()), len(self.keys) - 1).reshape(keys.shape)
            row, col = np.nonzero((self.keys[at] == keys) & (best[:, end - spans] > -np.inf))
            ids, start = self.key_ids[at[row, col]], end - spans[col]
            if self.bpe:
                inner = np.flatnonzero(start > 0)
                good = self.own[ids]
                good[inner] &= self._borders_hold(piece[row[inner], start[inner]], ids[inner])
                row, ids, start = row[good], ids[good], start[good]
                value = best[row, start] + np.float32(1)
            else:
                value = best[row, start] + self.scores[ids]
            order = np.lexsort((-start, value, row))
            row, ids, start, value = row[order], ids[order], start[order], value[order]
            top = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, np.int64)
            best[row[top], end], back[row[top], end], piece[row[top], end] = value[top], start[top], ids[top]
        out = np.full((words, length), -1, np.int64)
        place = np.full(words, length)
        while (live := np.flatnonzero(place > 0)).size:
            out[live, place[live] - 1] = piece[live, place[live]]
            place[live] = back[live, place[live]]
        return out

    def _known_pair(self, chars: np.ndarray) -> np.ndarray:
        key = (chars[:-1].astype(np.uint64) << np.uint64(32)) | chars[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), max(len(self.pairs) - 1, 0))
        return self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words in which a space is only at the start."""
        flat = _chars("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        cut = np.ones(len(flat) + 1, bool)
        if len(flat) > 1:
            cut[1:-1] = ~self._known_pair(flat)
        cut[first] = True
        begins = np.flatnonzero(cut[:-1])
        lengths = np.diff(np.append(begins, len(flat)))
        ids = np.full(len(flat), -1, np.int64)
        for length in np.unique(lengths):
            group = begins[lengths == length]
            for i in range(0, len(group), max(1, BATCH_WORDS // int(length))):
                part = group[i : i + max(1, BATCH_WORDS // int(length))]
                places = part[:, None] + np.arange(length)
                ids[places] = self._viterbi(flat[places])
        # A character that no way reaches has no piece: it stands alone, as pairs with it are in no piece.
        lone = np.flatnonzero((ids < 0) & cut[:-1] & np.append(cut[1:-1], True))
        ends = np.cumsum(sizes)
        out, special = [], set(np.searchsorted(ends, lone, "right").tolist())
        chosen = ids >= 0
        counts = np.concatenate([[0], np.cumsum(chosen)])
        packed = ids[chosen].astype("<u4").tobytes()
        for k, (a, b) in enumerate(zip(first.tolist(), ends.tolist(), strict=True)):
            if k not in special:
                out.append(packed[4 * counts[a] : 4 * counts[b]])
                continue
            own: list[int] = []
            for j in range(a, b):
                if ids[j] >= 0:
                    own.append(int(ids[j]))
                elif cut[j] and cut[j + 1]:
                    own.extend(self._unknown(chr(flat[j])))
            out.append(array("I", own).tobytes())
        return out

    def _unknown(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if len(self.byte_ids) == 256 else [self.unknown]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        kept = self.kept
        if len(kept) > MOST_KEPT:
            kept.clear()
        cut, missing = [], {}
        for text in texts:
            line = text.replace(" ", _SPACE)
            if line and self.prefix:
                line = _SPACE + line
            if line[:1] == _SPACE and _SPACE * 2 not in line and line[-1:] != _SPACE:
                words = [_SPACE + w for w in line[1:].split(_SPACE)]
            else:
                words = [w for w in _RUNS.findall(line) if w]
            cut.append(words)
            missing.update((w, None) for w in words if w not in kept)
        if missing:
            fresh = list(missing)
            kept.update(zip(fresh, self.encode_words(fresh), strict=True))
        return [b"".join([kept[w] for w in words]) for words in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 bytes of each id list: pieces' text with spaces, byte pieces' bytes, less the space put before the text."""
        of = self.bytes_of
        out = []
        for x in ids:
            text = b"".join([of[i] for i in np.frombuffer(x, "<u4").tolist()])
            out.append(text[1:] if self.prefix and text[:1] == b" " else text)
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """The worker's model for a file."""
    with open(path, "rb") as f:
        return Model(f.read())


_FIELDS = "n_tokens long, ids_crc32 long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids_sha256, decoded_sha256, round_trip) of every row; with ``keep_ids`` the ids too.

    CRC-32 and SHA-256 are of the ids as little-endian unsigned 32-bit integers and of the decoded
    text's UTF-8 bytes. round_trip says whether decoding gave the text back; a text that holds the
    model's own space sign does not come back, as it is read as a space. Null texts count as empty:
    no tokens. Repeated rows each get a row; no rows give none.
    """
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for part, texts in blocks(batches, "text"):
            ids = pieces.encode([t.decode() for t in texts])
            decoded = pieces.decode(ids)
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                pa.array([a == b for a, b in zip(texts, decoded, strict=True)]),
            ]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64).tolist() for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *(f.split()[0] for f in _FIELDS.split(", ")), *(["ids"] if keep_ids else [])])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, run, f"doc_id long, {_FIELDS}" + (", ids array<long>" if keep_ids else ""))


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
