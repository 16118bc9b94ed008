"""Vectorised words, hashes and shingles of whole texts, by numpy over Arrow's buffers.

A text is taken as UTF-8 bytes. Words are maximal runs of bytes that a table does not mark as
separators; A-Z are lower-cased where asked. A word's hash is a polynomial over its bytes modulo
2**64 with a fixed odd base, then mixed, so equal words have equal hashes in every task.
Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E6C63D0876A9A47)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = np.uint64(0xD1342543DE82EF95)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and bytes of longer UTF-8 characters.
PUNCTUATION = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base ("up") or of its inverse ("down") modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES)
        base = np.full(size, _BASE if kind == "up" else _INV, np.uint64)
        base[0] = 1
        have = _powers[kind] = np.multiply.accumulate(base)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column, and each text's bounds in them (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts that hold at most `limit` bytes, or one text."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = max(first + 1, min(last, n))
        yield first, last
        first = last


class Words:
    """Words of a block of texts: `hashes`, byte ranges `starts`/`ends`, and `first`, each text's bounds among them."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACES, lower: bool = True):
        n = len(raw)
        self.n_texts = len(bounds) - 1
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(self.n_texts + 1, np.int64)
            return
        word = ~separators[raw]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | cut[1:n]
        finishes = word.copy()
        finishes[:-1] &= ~word[1:] | cut[1:n]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, bounds)
        if len(self.starts):
            terms = (LOWER[raw] if lower else raw).astype(np.uint64)
            terms += np.uint64(1)
            terms *= _power("up", n)[:n]
            np.cumsum(terms, out=terms)
            before = np.where(self.starts > 0, terms[self.starts - 1], np.uint64(0))
            self.hashes = mix((terms[self.ends - 1] - before) * _power("down", n)[self.starts] + (self.ends - self.starts).astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words in order, and each text's bounds among them; a text of fewer words has one, its whole sequence, one of no words none."""
        counts = self.counts()
        each = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(each)])
        out = np.zeros(bounds[-1], np.uint64)
        if not bounds[-1]:
            return out, bounds
        words = self.hashes
        if len(words) >= size:
            rolled = words[: len(words) - size + 1].copy()
            for k in range(1, size):
                rolled *= _SHINGLE
                rolled += words[k : len(words) - size + 1 + k]
            rolled = mix(rolled)
            long = np.flatnonzero(counts >= size)
            at = np.repeat(self.first[long] - bounds[long], each[long]) + _ranges(bounds[long], each[long])
            out[_ranges(bounds[long], each[long])] = rolled[at]
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            out[bounds[i]] = self.runs(int(counts[i]), self.first[i], self.first[i + 1])[0]
        return out, bounds

    def runs(self, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Hashes of all runs of n words among words first to last, as of whole sequences of n words; they may cross texts."""
        words = self.hashes[first:last]
        if len(words) < n:
            return np.zeros(0, np.uint64)
        rolled = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            rolled *= _SHINGLE
            rolled += words[k : len(words) - n + 1 + k]
        return mix(rolled)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges starts[i] .. starts[i] + lengths[i]."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


ranges = _ranges


def word_blocks(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, last, Words) of consecutive blocks of a string column."""
    raw, bounds = text_bytes(texts)
    for a, b in blocks(bounds, limit):
        yield a, b, Words(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], separators, lower)


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct values in ascending order, and the new bounds. Sorts `hashes` in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    if not len(hashes):
        return hashes, bounds
    keep = np.ones(len(hashes), bool)
    keep[1:] = hashes[1:] != hashes[:-1]
    keep[bounds[:-1][bounds[:-1] < len(hashes)]] = True
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
