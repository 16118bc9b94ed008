"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Every benchmark item has weighted word shingles (rare ones of the benchmark weigh more) and a 256-bit
SimHash. In a document, every window of an item's length that shares a shingle with the item is
fingerprinted; a window without one has similarity 0, so nothing is left out. A multi-index over 8
blocks of 32 bits finds all items of that window's length within the radius: two fingerprints that
differ in at most `radius` bits differ in at most radius // 8 of some block, and a block's distinct
values within that are found by bit counts; of unlike items less than 3 % pass. The similarity of
window and item decides: the weighted or the plain one, whichever is larger, so an item that shares its
passages with others is not held to more than one that does not. Each has fingerprints of its own. The
weighted ones sum the shingles' signs by the square roots of their weights, so that the angle between
two fingerprints' sums follows the weighted similarity. Items in which a shingle repeats, where it
does not, are verified wherever a window shares a shingle with them.

The benchmark is read by the driver in bounded chunks, each of which goes to the executors with its
scan; documents are never moved. How many distinct texts of the whole benchmark hold a shingle is
counted before it is cut, so no verdict depends on what shares a chunk. Every chunk has the shingles
of more than one text with it, 16 bytes for each.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import PUNCTUATION, Words, mix, ranges, word_blocks

BITS, BLOCK_BITS = 256, 32
#: A window at similarity 0.8 differs from the item in 38.8 bits on average, standard deviation 5.7; this is 4.6 of them more.
RADIUS = 65
#: Words of benchmark text that are sent to the executors at once; a longer benchmark takes several scans.
CHUNK_WORDS = 1_000_000
#: Positions of windows fingerprinted at once, and comparisons of block values.
WINDOWS_AT_ONCE, COMPARED_AT_ONCE = 1 << 12, 1 << 22
_PARTS = np.array([0x0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F], np.uint64)


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash's 256."""
    wide = mix(np.ascontiguousarray(hashes)[:, None] + _PARTS)
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Four 64-bit integers for each row of sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)


_NONE = np.zeros(0, np.uint64), np.zeros(0, np.int64)


class Index:
    """Fingerprints of items of one length: by blocks, the distinct values and each item's place among them."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        self.blocks = [np.unique(values, return_inverse=True) for values in np.ascontiguousarray(prints).view(np.uint32).T]

    def candidates(self, marks: np.ndarray, radius: int) -> np.ndarray:
        """Whether some block of a mark (row) lies within the radius' share of an item's (column)."""
        out = np.zeros((len(marks), len(self.items)), bool)
        for (values, place), own in zip(self.blocks, np.ascontiguousarray(marks).view(np.uint32).T):
            near = np.bitwise_count(values ^ own[:, None]) <= radius // (BITS // BLOCK_BITS)
            if near.any():
                out |= near[:, place]
        return out

    def within(self, marks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a mark and an item that differ in at most `radius` bits."""
        rows, items = [], []
        for a in range(0, len(marks), step := max(1, COMPARED_AT_ONCE // len(self.items))):
            w, i = np.nonzero(self.candidates(marks[a : a + step], radius))
            close = np.bitwise_count(marks[a + w] ^ self.prints[i]).sum(axis=1, dtype=np.int64) <= radius
            rows.append(a + w[close])
            items.append(self.items[i[close]])
        return np.concatenate(rows), np.concatenate(items)


class Benchmark:
    """Items with their shingles and weights, and the multi-index of their fingerprints."""

    def __init__(self, ids: list[int], texts: pa.Array, size: int, radius: int, shared: tuple[np.ndarray, np.ndarray] = _NONE):
        """`shared`: shingles that several distinct texts of the whole benchmark hold, ascending, and how many hold each."""
        parts = [(block.counts(), *block.shingles(size)) for _, _, block in word_blocks(texts, PUNCTUATION)]
        shingles = np.concatenate([np.zeros(0, np.uint64), *(x for _, x, _ in parts)])
        held = np.concatenate([np.zeros(0, np.int64), *(np.diff(bounds) for *_, bounds in parts)])
        self.lengths = np.concatenate([np.zeros(0, np.int64), *(n for n, *_ in parts)])
        self.size, self.radius, self.ids = size, radius, np.array(ids, np.int64)
        self.vocabulary = np.unique(np.concatenate([shingles, shared[0]]))
        spread = np.ones(len(self.vocabulary))
        spread[np.searchsorted(self.vocabulary, shared[0])] = shared[1]
        #: A shingle of one text weighs 1; one that many share, less, but never nothing.
        self.weights = 1 / (1 + np.log(spread))
        self.weighted = bool((spread > 1).any())
        first = np.concatenate([[0], np.cumsum(held)])
        owners, place = np.repeat(np.arange(len(held)), held), np.searchsorted(self.vocabulary, shingles)
        order = np.lexsort((place, owners))
        owners, place = owners[order], place[order]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (owners[1:] != owners[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(fresh)
        #: Each item's distinct shingles (places in the vocabulary, ascending), how often it has each, and items' bounds among them.
        self.places, self.counts = place[at], np.diff(np.append(at, len(place)))
        self.bounds = np.searchsorted(owners[at], np.arange(len(held) + 1))
        order = np.argsort(self.places, kind="stable")
        self.holders = owners[at][order]
        self.holder_bounds = np.searchsorted(self.places[order], np.arange(len(self.vocabulary) + 1))
        prints = np.zeros((2, len(held), BITS // 64), np.uint64)
        for i in np.flatnonzero(held).tolist():
            own = shingles[first[i] : first[i + 1]]
            signs = bit_signs(own)
            prints[0, i] = fingerprints(signs.sum(axis=0, keepdims=True))
            if self.weighted:
                prints[1, i] = fingerprints(np.round((signs * np.sqrt(self.weights[np.searchsorted(self.vocabulary, own)])[:, None]).sum(axis=0, keepdims=True), 9))
        #: Items of fewer words than a shingle: one run of words each, equal or not, by length and hash.
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i in np.flatnonzero((self.lengths > 0) & (self.lengths < size)).tolist():
            self.short[int(self.lengths[i])][int(shingles[first[i]])].append(i)
        self.short = {n: dict(table) for n, table in self.short.items()}
        repeats = np.zeros(len(held), bool)
        repeats[owners[at][self.counts > 1]] = True
        #: For each length the indexes of its items, plain and (if any weigh less) weighted, and the items in which a shingle repeats.
        self.index: dict[int, list[Index]] = {}
        self.loose: dict[int, np.ndarray] = {}
        for length in np.unique(self.lengths[self.lengths >= size]).tolist():
            same = np.flatnonzero(self.lengths == length)
            self.loose[length] = same[repeats[same]]
            self.index[length] = [Index(same, kind[same]) for kind in prints[: 1 + self.weighted]]

    def candidates(self, marks: list[np.ndarray], length: int) -> list[tuple[int, int]]:
        """Pairs of a window and an item to verify, in order; `marks` are the windows' plain and weighted fingerprints."""
        pairs = {p for index, own in zip(self.index[length], marks) for p in zip(*(x.tolist() for x in index.within(own, self.radius)))}
        pairs.update((w, i) for i in self.loose[length].tolist() for w in range(len(marks[0])))
        return sorted(pairs)

    def similarity(self, item: int, window: np.ndarray, other_weight: float = 1.0) -> float:
        """Jaccard of multisets, weighted or plain, the larger: `window` has places in the vocabulary, -1 for other shingles."""
        known = window[window >= 0]
        unknown = len(window) - len(known)
        have, n_have = np.unique(known, return_counts=True)
        own = slice(self.bounds[item], self.bounds[item + 1])
        want, n_want = self.places[own], self.counts[own]
        every = np.union1d(want, have)
        a, b = np.zeros((2, len(every)), np.int64)
        a[np.searchsorted(every, want)], b[np.searchsorted(every, have)] = n_want, n_have
        least, most, weights = np.minimum(a, b), np.maximum(a, b), self.weights[every]
        if not least.any():
            return 0.0
        # exact sums, as the order of places differs from chunk to chunk
        weighted = math.fsum((weights * least).tolist()) / math.fsum([unknown * other_weight, *(weights * most).tolist()])
        return max(weighted, int(least.sum()) / (unknown + int(most.sum())))


def windows(signed: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows of `width` rows that begin at these rows."""
    sums = np.zeros((len(signed) + 1, BITS))
    np.cumsum(signed, axis=0, out=sums[1:])
    return fingerprints(np.round(sums[begin + width] - sums[begin], 9))


def _search(benchmark: Benchmark, least: float, clean_at: int | None = None):
    """Emits a row for each leak or, with `clean_at` (the text's column), the rows of the input that hold none."""
    size = benchmark.size

    def document(shingles: np.ndarray, places: np.ndarray, n_words: int) -> dict[int, tuple[float, int]]:
        best: dict[int, tuple[float, int]] = {}
        met = np.flatnonzero(places >= 0)
        # for each length of item, the starts of windows that hold a shingle of an item of that length
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for at in met.tolist():
            p = places[at]
            for length in np.unique(benchmark.lengths[benchmark.holders[benchmark.holder_bounds[p] : benchmark.holder_bounds[p + 1]]]).tolist():
                starts[length].append((max(0, at - max(length - size, 0)), min(at, max(0, n_words - length)) + 1))
        for length, spans in starts.items():
            if length < size:
                continue
            if length > n_words and length > size:
                length_here = n_words
            else:
                length_here = length
            width = max(1, length_here - size + 1)
            begin = _union(spans)
            for k in range(0, len(begin), WINDOWS_AT_ONCE):
                some = begin[k : k + WINDOWS_AT_ONCE]
                some = some[some + width <= len(shingles)]
                if not len(some):
                    continue
                low, high = int(some[0]), int(some[-1]) + width
                here, signs = places[low:high], bit_signs(shingles[low:high])
                marks = [windows(signs, some - low, width)]
                if benchmark.weighted:
                    signs *= np.sqrt(np.where(here >= 0, benchmark.weights[here], 1.0))[:, None]
                    marks.append(windows(signs, some - low, width))
                for at, item in benchmark.candidates(marks, length):
                    start = int(some[at])
                    value = benchmark.similarity(item, places[start : start + width])
                    if value >= least and (item not in best or (-value, start) < (-best[item][0], best[item][1])):
                        best[item] = (value, start)
        return best

    def short(block: Words) -> dict[int, dict[int, tuple[float, int]]]:
        """For each text of a block the short items that it holds, with the first place."""
        out: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        for n, table in benchmark.short.items():
            runs = block.runs(n)
            at = np.flatnonzero(np.isin(runs, np.array(list(table), np.uint64)))
            texts = np.searchsorted(block.first, at, "right") - 1
            for i, d in zip(at.tolist(), texts.tolist()):
                if i + n <= block.first[d + 1]:
                    for item in table[int(runs[i])]:
                        out[d].setdefault(item, (1.0, i - int(block.first[d])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = benchmark.vocabulary
        sieve = np.zeros(1 << 20, bool)
        sieve[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            rows, clean = [], np.ones(len(batch), bool)
            for first, _, block in word_blocks(batch.column(1 if clean_at is None else clean_at), PUNCTUATION):
                shingles, bounds = block.shingles(size)
                maybe = np.flatnonzero(sieve[(shingles >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(vocabulary, shingles[maybe]), max(len(vocabulary) - 1, 0))
                hit = vocabulary[place] == shingles[maybe] if len(vocabulary) else np.zeros(len(maybe), bool)
                maybe, place = maybe[hit], place[hit]
                counts = block.counts()
                brief = short(block)
                for d in sorted({*(np.searchsorted(bounds, maybe, "right") - 1).tolist(), *brief}):
                    a, b = bounds[d], bounds[d + 1]
                    places = np.full(b - a, -1, np.int64)
                    own = (maybe >= a) & (maybe < b)
                    places[maybe[own] - a] = place[own]
                    found = document(shingles[a:b], places, int(counts[d])) | brief.get(d, {})
                    if clean_at is not None:
                        clean[first + d] = not found
                        continue
                    doc_id = batch.column(0)[first + d].as_py()
                    for item, (value, start) in found.items():
                        rows.append((doc_id, int(benchmark.ids[item]), start, int(benchmark.lengths[item]), value))
            if clean_at is not None:
                yield batch.filter(pa.array(clean))
                continue
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def _union(spans: list[tuple[int, int]]) -> np.ndarray:
    """All positions that lie in one of the ranges, ascending."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        elif b > a:
            merged.append([a, b])
    return ranges(np.array([a for a, _ in merged]), np.array([b - a for a, b in merged])) if merged else np.zeros(0, np.int64)


def _texts_of_shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in word_blocks(batch.column(0), PUNCTUATION):
                shingles, bounds = block.shingles(size)
                # equal sequences of words are one text, however they are written
                yield pa.RecordBatch.from_arrays([pa.array(block.counts(), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(shingles.view(np.int64)))], names=["n", "shingles"])

    return run


def shared_shingles(benchmark: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several distinct texts of the benchmark hold, ascending, and how many texts hold each."""
    texts = benchmark.filter("text is not null and item_id is not null").select("text").mapInArrow(_texts_of_shingles(size), "n long, shingles array<long>").distinct()
    found = texts.select(F.explode(F.array_distinct("shingles")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    h, n = found["h"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _chunks(benchmark: DataFrame, chunk_words: int) -> Iterator[tuple[list[int], pa.Array]]:
    """The benchmark in pieces of bounded size, one partition of it at a time on the driver."""
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    ids, texts, words = [], [], 0
    for row in items.toLocalIterator():
        n = len(row.text.split())
        if texts and words + n > chunk_words:
            yield ids, pa.array(texts, pa.large_string())
            ids, texts, words = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        words += n
    if texts:
        yield ids, pa.array(texts, pa.large_string())


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, words: int = 5, radius: int = RADIUS, chunk_words: int = CHUNK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity) for each document and item with a window alike.

    The window is the most similar one of the item's number of words (ties: the first), or the whole
    document where it is shorter. Words are runs of letters and digits, A-Z lower-cased. Items without
    words (null, empty) match nothing; items of fewer words than a shingle match as one shingle. Rows
    that share an id are searched each for itself, and items that share an id too. Rows without an id
    keep null. No documents or no items give no rows; other columns are ignored. Very long texts are searched whole,
    their windows in bounded runs.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    out, shared = None, shared_shingles(benchmark, words)
    for ids, texts in _chunks(benchmark, chunk_words):
        part = docs.mapInArrow(_search(Benchmark(ids, texts, words, radius, shared), least), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("doc_id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, words: int = 5, radius: int = RADIUS, chunk_words: int = CHUNK_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark, unchanged; see find_leaks.

    Null and empty texts hold none and stay; repeated rows are judged each for itself; null ids do not matter. No items: all stay.
    """
    at, shared = docs.columns.index(text_col), shared_shingles(benchmark, words)
    for ids, texts in _chunks(benchmark, chunk_words):
        docs = docs.mapInArrow(_search(Benchmark(ids, texts, words, radius, shared), least, at), docs.schema)
    return docs
