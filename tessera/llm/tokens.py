"""Token ids of whole texts by the `tokenizers` library, each distinct piece of text encoded once.

A text is cut where no token can cross, judged from the tokenizer's own definition: for byte-level
BPE before a single space and around a single line feed between other characters; for tokenizers
that drop white space, at white space. Pieces are known by a 64-bit hash in a bounded table, so only
pieces that the table lacks reach the library. Texts with other white space than ASCII or with the
string of an added token, where cuts would not be safe, and tokenizers of other kinds are encoded whole.
Ids are those of the untouched library: the string of a special token in a text gives that token.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .words import SPACES, _power, blocks, mix, ranges, text_bytes

SLOTS_LOG2 = 22
MOST_ENTRIES, MOST_IDS = 1_000_000, 8_000_000
LATIN, OTHER_LEADS = 0xC2, (0xE1, 0xE2, 0xE3)
WIDE_SPACES = ("\u0085", " ", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")


def cutting(definition: dict) -> str:
    """Where texts may be cut: "space", "word" or "never"."""
    before, normal = definition.get("pre_tokenizer") or {}, definition.get("normalizer")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
        return "space"
    splits = [x for x in before.get("pretokenizers", []) if x["type"] == "Split"]
    removes = splits and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and r"[^\s\p{L}\p{N}]+" in splits[0]["pattern"].get("Regex", "")
    plain = all(x["type"] in ("NFC", "Replace", "Lowercase") for x in (normal or {}).get("normalizers", []))
    return "word" if removes and plain else "never"


class Encoder:
    def __init__(self, definition: str, special_as_text: bool = False):
        """`special_as_text`: special tokens' strings in a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = special_as_text
        known = json.loads(definition)
        added = known.get("added_tokens") or []
        self.rule = "never" if any(t.get("normalized") for t in added) else cutting(known)
        self.added = [t["content"].encode() for t in added]
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << SLOTS_LOG2, -1, np.int32)
        self.hash, self.start, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.n, self.used = np.zeros(1 << 18, np.uint32), 0, 0

    def library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a block of texts."""
        space = SPACES[raw]
        if self.rule == "word":
            cut = np.zeros(len(raw) + 1, bool)
            cut[bounds] = True
            begins, finishes = ~space, ~space
            begins[1:] &= space[:-1] | cut[1:-1]
            finishes[:-1] &= space[1:] | cut[1:-1]
            for a, b in self._whole(raw, bounds):
                begins[a:b] = finishes[a:b] = False
                begins[a] = finishes[b - 1] = True
            return np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        lone = np.zeros(len(raw), bool)
        if self.rule == "space":
            lone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
        begins = lone & (raw == 0x20)
        feed = lone & (raw == 0x0A)
        begins |= feed
        begins[1:] |= feed[:-1]
        if self.rule == "space" and ((raw == LATIN) | (raw >= OTHER_LEADS[0]) & (raw <= OTHER_LEADS[2])).any():
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = raw[a:b]
                if ((part == LATIN) | (part >= OTHER_LEADS[0]) & (part <= OTHER_LEADS[2])).any() and any(s in part.tobytes().decode() for s in WIDE_SPACES):
                    begins[a:b] = False
        for a, b in self._whole(raw, bounds):
            begins[a:b] = False
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(raw))

    def _whole(self, raw: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Bounds of the texts that hold the string of an added token."""
        data, found = raw.tobytes(), set()
        for string in self.added:
            at = data.find(string)
            while at >= 0:
                k = int(np.searchsorted(bounds, at, "right"))
                if at + len(string) <= bounds[k]:
                    found.add((int(bounds[k - 1]), int(bounds[k])))
                    at = data.find(string, int(bounds[k]))
                else:
                    at = data.find(string, at + 1)
        return sorted(found)

    def _block(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        starts, ends = self._pieces(raw, bounds)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power("up", len(raw))[: len(raw)]
        np.cumsum(terms, out=terms)
        before = np.where(starts > 0, terms[starts - 1], np.uint64(0))
        h = mix((terms[ends - 1] - before) * _power("down", len(raw))[starts] + (ends - starts).astype(np.uint64))
        if self.n > MOST_ENTRIES or self.used > MOST_IDS:
            self._clear()
        slot = (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)
        entry = self.slots[slot]
        missing = np.flatnonzero((entry < 0) | (self.hash[entry] != h))
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            data = raw.tobytes()
            ids, sizes = self.library([data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self._keep(new, ids, sizes)
            added = np.arange(self.n - len(new), self.n, dtype=np.int32)
            self.slots[slot[at]] = added
            entry[missing] = added[back]
        sizes = self.size[entry].astype(np.int64)
        ids = self.pool[ranges(self.start[entry], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[np.searchsorted(starts, bounds)])

    def _keep(self, new: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(new), self.used + len(ids)
        while n > len(self.hash):
            self.hash, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.start, self.size))
        while used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.hash[self.n : n], self.size[self.n : n] = new, sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : used] = ids
        self.n, self.used = n, used

    def encode(self, texts: pa.Array):
        """Yields (first text, ids of a block of texts in a row, number of ids of each)."""
        raw, bounds = text_bytes(texts)
        for a, b in blocks(bounds):
            yield a, *self._block(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """This process's encoder for a tokenizer's JSON definition; it lives as long as the worker, with its table."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with an end id after every text."""
    counts = counts.astype(np.int64)
    return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1
