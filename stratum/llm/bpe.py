"""Byte-level BPE ids of whole texts through the tokenizers library, each distinct word once.

The pre-tokenizer's expression never looks back and lets a word take the one space before it, so
where every run of white space is a single space or line break, a text's ids are those of its words,
each with its space, and of the breaks. Words of a block of texts are found by array operations. A
word of at most ``SHORT`` bytes is two 64-bit integers, which are looked up for all words at once in
an open-addressing table that the worker keeps: no hash stands for a word, so equal means equal. A
word that is new is encoded by the library's BPE model and put into the table; the first ``MOST_KEPT``
stay, as frequent words come early. Longer and later words are kept in a dictionary that starts anew
at ``MOST_RECENT``. Marks that end a word after an ASCII letter or digit are always pieces of their own,
so they count as a word, which lets far fewer words be distinct. Other words that are not letters
followed by marks go through the library's whole pipeline, and so do texts with other white space or
with one of the tokenizer's added tokens.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
MOST_KEPT = 500_000
MOST_RECENT = 150_000
SHORT = 15
_SLOT_BITS = 20
#: Runs of these are one piece for the pre-tokenizer; the apostrophe may start a contraction.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_encoders: dict[str, WordEncoder] = {}
_EDGE, _CONTROL, _LEAD = 1, 2, 3
_SPACES = {0xC2: {(0x85,), (0xA0,)}, 0xE1: {(0x9A, 0x80)}, 0xE2: {(0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)} | {(0x81, 0x9F)}, 0xE3: {(0x80, 0x80)}}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _byte_kinds() -> np.ndarray:
    """Of each byte: does it end words (space, line break and the 0 between texts), is it another control, may it start a wider white space."""
    out = np.zeros(256, np.uint8)
    out[:32] = _CONTROL
    out[[0, 10, 32]] = _EDGE
    out[list(_SPACES)] = _LEAD
    return out


_KINDS = _byte_kinds()
_IS_MARK = np.isin(np.arange(256), list(_MARKS.encode()))
_IS_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_MASKS = np.array([[(1 << 8 * min(max(n - 8 * half, 0), 8)) - 1 for half in (0, 1)] for n in range(SHORT + 1)], np.uint64)


class WordEncoder:
    """The ids of words and texts for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.recent: dict[tuple[bytes, bool], list[int]] = {}
        self._sizes: np.ndarray | None = None
        self.kept = 0
        self.keys = np.zeros((2, 1 << _SLOT_BITS), np.uint64)
        self.start, self.count = np.zeros(1 << _SLOT_BITS, np.int32), np.zeros(1 << _SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.line_break = self._piece(b"\n")

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        """The worker's encoder for a file."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _piece(self, raw: bytes) -> list[int]:
        """Of what the pre-tokenizer keeps in one piece."""
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))]

    def _word(self, raw: bytes, bare: bool) -> list[int]:
        """Of a word with the space before it, or bare: at the start of a text, a line or of marks after a word."""
        if raw.isalpha():  # ASCII letters are written as themselves
            word = raw.decode()
            return [t.id for t in self.model.tokenize(word if bare else self.letters[32] + word)]
        word, space = raw.decode(), b"" if bare else b" "
        core = word.rstrip(_MARKS)
        if core and not core.isalpha():
            return self._whole([(space + raw).decode()])[0]
        if core and core != word:
            return self._piece(space + core.encode()) + self._piece(word[len(core) :].encode())
        return self._piece(space + raw)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _recent(self, raw: bytes, bare: bool) -> list[int]:
        ids = self.recent.get((raw, bare))
        if ids is None:
            if len(self.recent) >= MOST_RECENT:
                self.recent.clear()
            ids = self.recent[raw, bare] = self._word(raw, bare)
        return ids

    def _keep(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray, words: list[tuple[bytes, bool]]) -> None:
        """Encode words that the table doesn't have, and put each into the first free slot from its own on."""
        ids = [self._word(*w) for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        stops = self.used + np.cumsum(sizes)
        while stops[-1] > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : stops[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.used = int(stops[-1])
        self.kept += len(words)
        live = np.arange(len(words))
        while len(live):
            free = np.flatnonzero(self.keys[0][slot] == 0)
            taken, which = np.unique(slot[free], return_index=True)
            own = live[free[which]]
            self.keys[0][taken], self.keys[1][taken] = low[own], high[own]
            self.start[taken], self.count[taken] = stops[own] - sizes[own], sizes[own]
            rest = np.ones(len(live), bool)
            rest[free[which]] = False
            live, slot = live[rest], (slot[rest] + 1) & ((1 << _SLOT_BITS) - 1)

    def _slots(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The table's slot of each word, -1 for one it hasn't."""
        found = np.full(len(slot), -1, np.int64)
        live = np.arange(len(slot))
        while len(live):
            there = self.keys[0][slot]
            same = (there == low[live]) & (self.keys[1][slot] == high[live])
            found[live[same]] = slot[same]
            on = np.flatnonzero(~same & (there != 0))
            live, slot = live[on], (slot[on] + 1) & ((1 << _SLOT_BITS) - 1)
        return found

    def _unusual(self, texts: list[bytes], joined: bytes, raw: np.ndarray, kinds: np.ndarray, seps: np.ndarray) -> set[int]:
        """Texts that words with single spaces or line breaks between them don't make up, or that hold an added token."""
        edge = kinds == _EDGE
        both = np.flatnonzero(edge[1:] & edge[:-1])
        both = both[(raw[both] | raw[both + 1]) != 0]
        at = [np.where(raw[both] != 0, both, both + 1), np.flatnonzero(kinds == _CONTROL)]
        leads = np.flatnonzero(kinds == _LEAD)
        for lead, tails in _SPACES.items():
            here = leads[raw[leads] == lead]
            for tail in tails:
                match = here
                for k, b in enumerate(tail, start=1):
                    match = match[raw[np.minimum(match + k, len(raw) - 1)] == b]
                at.append(match)
        out = set((np.searchsorted(seps, np.concatenate(at), "left") - 1).tolist())
        for token in self.added:
            if token.encode() in joined:
                out.update(i for i, t in enumerate(texts) if token.encode() in t)
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), one text after the other, and how many each has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = {i for i, t in enumerate(texts) if b"\0" in t}
        plain = [b"" if i in odd else t for i, t in enumerate(texts)] if odd else texts
        while True:
            joined = b"\0%b\0" % b"\0".join(plain)
            raw = np.frombuffer(joined, np.uint8)
            kinds, seps = _KINDS[raw], np.flatnonzero(raw == 0)
            more = self._unusual(plain, joined, raw, kinds, seps)
            if len(self.line_break) != 1:
                more.update(i for i, t in enumerate(plain) if b"\n" in t)
            if not more:
                break
            odd |= more
            plain = [b"" if i in odd else t for i, t in enumerate(plain)]
        ids, counts = self._plain(joined, raw, kinds == _EDGE, seps)
        if not odd:
            return ids, counts
        parts, stops = [], np.cumsum(counts)
        for i, stop in enumerate(stops.tolist()):
            if i in odd:
                whole = self._whole([texts[i].decode()])[0]
                counts[i] = len(whole)
                parts.append(np.array(whole, np.uint32))
            else:
                parts.append(ids[stop - counts[i] : stop])
        return np.concatenate(parts), counts

    def _plain(self, joined: bytes, raw: np.ndarray, edge: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1, np.flatnonzero(~edge[:-1] & edge[1:]) + 1
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(seps) - 1, np.int64)
        last = np.maximum.accumulate(np.where(_IS_MARK[raw], 0, np.arange(len(raw))))[ends - 1]
        split = last[(last < ends - 1) & (last >= begins) & _IS_ALNUM[raw[last]]] + 1
        begins, ends = np.sort(np.concatenate([begins, split]), kind="stable"), np.sort(np.concatenate([ends, split]), kind="stable")
        first = np.searchsorted(begins, seps)
        lead = np.where(edge[begins - 1], raw[begins - 1], 0)
        sizes = ends - begins
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        pair = np.lib.stride_tricks.as_strided(padded, (len(raw), 16), (1, 1))[begins].view("<u8") & _MASKS[np.minimum(sizes, SHORT)]
        low, high = pair[:, 0].copy(), pair[:, 1] | ((lead != 32).astype(np.uint64) << np.uint64(56))
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD1342543DE82EF95)
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        found = self._slots(low, high, slot)
        found[sizes > SHORT] = -1
        missing = np.flatnonzero((found < 0) & (sizes <= SHORT))
        while len(missing) and self.kept < MOST_KEPT:
            new = missing[np.unique(mixed[missing], return_index=True)[1]]
            new = np.sort(new)[: MOST_KEPT - self.kept]
            words = [(joined[b:e], bare) for b, e, bare in zip(begins[new].tolist(), ends[new].tolist(), (lead[new] != 32).tolist(), strict=True)]
            self._keep(low[new], high[new], slot[new], words)
            found[missing] = self._slots(low[missing], high[missing], slot[missing])
            missing = missing[found[missing] < 0]
        start, count = self.start[found].astype(np.int64), self.count[found].astype(np.int64)
        extra, at = [], self.used
        for i in np.flatnonzero(found < 0).tolist():
            ids = self._recent(joined[begins[i] : ends[i]], bool(lead[i] != 32))
            extra += ids
            start[i], count[i] = at, len(ids)
            at += len(ids)
        pool = np.concatenate([self.pool[: self.used], np.array(extra, np.uint32)]) if extra else self.pool
        stops = np.cumsum(count)
        out = pool[np.repeat(start - stops + count, count) + np.arange(stops[-1])]
        broken = lead == 10
        if broken.any():
            out = np.insert(out, (stops - count)[broken], self.line_break[0])
            stops = stops + np.cumsum(broken)
        upto = np.concatenate([[0], stops])[first]
        return out, np.diff(upto)

    def token_sizes(self) -> np.ndarray:
        """Bytes of text that each id stands for."""
        if self._sizes is None:
            vocab = self.tokenizer.get_vocab()
            self._sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._sizes[i] = len(token.encode()) if token in self.added else len(token)
        return self._sizes
