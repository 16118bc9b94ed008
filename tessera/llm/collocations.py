"""Phrase collocations by hashed pruning (PCY, DHP) and Apriori.

Pass n counts phrases of n words exactly and, in the same scan, adds up how often phrases of n + 1 words
fall into each of 2 ** BITS buckets. Buckets that reach the least count make a bitmap; phrases that reach
it make another, in which the next pass looks their continuations up. A phrase of n + 1 words is
counted only where its own bucket and both of its runs of n words are marked, so most rare phrases are
never counted, shuffled or spelled out. What the bitmaps let through by chance the exact count ends.

A task adds equal phrases up before it sends them; a bucket's count is saturated at the least count,
compressed by slices of buckets, and slices are summed by a stream over sorted rows. Two bitmaps of
2 ** BITS bits are all that is broadcast, whatever the corpus. Counts of parts are joined to candidates by
sort-merge joins.

Everything is counted for each language apart. A phrase's language and words are one 64-bit hash within
a task; between tasks they are strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, clean_shuffles
from .words import LOWER, Words, blocks, mix, ranges, text_bytes

#: Buckets of a pass (a byte each in a task, a bit each in a bitmap), and slices that they travel in.
BITS, SLICES = 25, 256
#: Shares of a language's phrases whose first are found apart.
SHARES = 64
#: Text bytes of a block, and distinct phrases that a task holds before it sends them.
BLOCK, HELD = 1 << 20, 1 << 18
UNKNOWN = "und"

#: Fixed: what ends a piece, and what ends a word within one.
CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATORS = CUTS.copy()
SEPARATORS[[0x20, 0x09]] = True


class Runs:
    """Runs of words of a block of texts that lie within one piece each."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, lang_hashes: np.ndarray):
        self.raw, self.words = raw, Words(raw, bounds, SEPARATORS, lower=True)
        counts = self.words.counts()
        self.text = np.repeat(np.arange(len(counts)), counts)
        self.lang = lang_hashes[self.text] if len(self.text) else np.zeros(0, np.uint64)
        cuts = np.concatenate([[0], np.cumsum(CUTS[raw])])
        n = len(self.words.starts)
        self.joined = np.zeros(n, bool)  # whether a word and the next are in one piece
        if n > 1:
            self.joined[:-1] = (cuts[self.words.starts[1:]] == cuts[self.words.ends[:-1]]) & (self.text[1:] == self.text[:-1])

    def keys(self, n: int) -> np.ndarray:
        """The hash of each word's run of n words and its language; meaningless where `whole` is not."""
        out = np.zeros(len(self.lang), np.uint64)
        runs = self.words.runs(n)
        out[: len(runs)] = mix(runs ^ self.lang[: len(runs)])
        return out

    def whole(self, n: int) -> np.ndarray:
        """Whether n words from this one on are in one piece."""
        out = np.ones(len(self.joined), bool)
        for k in range(n - 1):
            out &= _ahead(self.joined, k)
        return out

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The runs of n words from words `at`, lower-cased, one space between words."""
        word = (at[:, None] + np.arange(n)).ravel()
        starts, lengths = self.words.starts[word], self.words.ends[word] - self.words.starts[word]
        gaps = np.tile(np.arange(n) < n - 1, len(at)).astype(np.int64)
        ends = np.cumsum(lengths + gaps)
        flat = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
        flat[ranges(ends - lengths - gaps, lengths)] = LOWER[self.raw[ranges(starts, lengths)]]
        offsets = np.concatenate([[0], ends[n - 1 :: n]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat))


def _ahead(marks: np.ndarray, k: int) -> np.ndarray:
    """marks[i + k] at i, False beyond the end."""
    return np.concatenate([marks[k:], np.zeros(min(k, len(marks)), bool)]) if k else marks


def _marked(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(keys), bool)
    slot = keys >> np.uint64(65 - (len(bitmap) * 64).bit_length())  # as many leading bits as the bitmap has places for
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


class Tally:
    """Exact counts of a task's phrases by key."""

    def __init__(self):
        self.keys, self.counts, self.phrases, self.langs = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.string()), pa.array([], pa.string())

    def add(self, keys: np.ndarray, counts: np.ndarray, phrases: pa.Array, langs: pa.Array) -> None:
        every = np.concatenate([self.keys, keys])
        self.keys, at, place = np.unique(every, return_index=True, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        at = pa.array(at)
        self.phrases, self.langs = pa.concat_arrays([self.phrases, phrases]).take(at), pa.concat_arrays([self.langs, langs]).take(at)

    def flush(self) -> Iterator[pa.RecordBatch]:
        size = len(self.keys)
        for a in range(0, size, 1 << 16):
            n = min(1 << 16, size - a)
            yield pa.RecordBatch.from_arrays(
                [self.langs.slice(a, n), self.phrases.slice(a, n), pa.array(self.keys[a : a + n].view(np.int64)), pa.array(self.counts[a : a + n]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=NAMES
            )
        self.__init__()


NAMES = ["lang", "phrase", "key", "n", "slice", "counts"]
COUNTED = "lang string, phrase string, key long, n long, slice int, counts binary"


def _count(n: int, longest: int, least: int, buckets: np.ndarray | None, frequent: np.ndarray | None):
    """Pass n: phrases of n words with their counts, and slices of the bucket counts of n + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, hashes = Tally(), {}
        sums = np.zeros(1 << BITS, np.min_scalar_type(least)) if n < longest else None
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                hashes.setdefault(lang, xxhash.xxh64_intdigest(lang))
            own = np.array([hashes[x] for x in langs.to_pylist()], np.uint64)
            raw, bounds = text_bytes(batch.column(1))
            for a, b in blocks(bounds, BLOCK):
                runs = Runs(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], own[a:b])
                keys = runs.keys(n)
                may = runs.whole(n) & _marked(buckets, keys)
                if frequent is not None:
                    part = _marked(frequent, runs.keys(n - 1))
                    may &= part & _ahead(part, 1)
                at = np.flatnonzero(may)
                distinct, first, times = np.unique(keys[at], return_index=True, return_counts=True)
                first = at[first]
                tally.add(distinct, times, runs.phrases(first, n), langs.slice(a, b - a).take(pa.array(runs.text[first])))
                if sums is not None:
                    both = may & _ahead(may, 1) & runs.whole(n + 1)
                    slots, times = np.unique((runs.keys(n + 1)[both] >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
                    sums[slots] = np.minimum(sums[slots] + np.minimum(times, least), least)
                if len(tally.keys) > HELD:
                    yield from tally.flush()
        yield from tally.flush()
        if sums is not None:
            for s, part in enumerate(sums.reshape(SLICES, -1)):
                if part.any():
                    squeezed = zstandard.ZstdCompressor(level=1).compress(part.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([s], pa.int32()), pa.array([squeezed], pa.binary())], names=NAMES)

    return run


def _summed(least: int):
    """Rows sorted by slice: the bits of the slice's buckets that reach the least count, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])
        for batch in batches:
            for s, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.min_scalar_type(least))
                if s != now:
                    if now is not None:
                        yield done()
                    now, sums = s, np.zeros(len(part), np.int64)
                sums += part
        if now is not None:
            yield done()

    return run


def _full_buckets(counted: DataFrame, least: int) -> np.ndarray:
    """The bitmap of buckets that reach the least count: at most SLICES rows of 2 ** BITS / SLICES bits come to the driver."""
    rows = counted.filter("slice is not null").select("slice", "counts").repartition("slice").sortWithinPartitions("slice")
    out = np.zeros((SLICES, (1 << BITS) // SLICES // 64), np.uint64)
    for row in rows.mapInArrow(_summed(least), "slice int, bits binary").collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint64)
    return out.ravel()


def _frequent_keys(frequent: DataFrame) -> np.ndarray:
    """The bitmap of the phrases that reach the least count: at most 2 ** (BITS - 6) rows of two numbers come to the driver."""
    slot = F.shiftrightunsigned("key", 64 - BITS)
    bits = F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))"))
    found = frequent.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(bits.alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: tuple[int, int] = (50, 100), top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and pieces into words at spaces and tabs. f counts a
    phrase's occurrences within pieces, n all words, for each language (null: `und`). Candidates have a = f >= `least`. A cut into two parts
    with l and r occurrences scores floor(10**6 a a / (l r)), exact in decimals of 38 digits; the lowest cut counts, ties to the shorter first part. A candidate
    within a longer one with f(longer) / a >= inside[0] / inside[1] goes, whatever becomes of the longer one. Ranks are by score
    and a descending, then the phrase in byte order.

    Null and empty texts hold no words; a very long text is a block of its own; repeated rows count each; other columns are
    ignored; an empty table gives no rows.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    frequent: dict[int, DataFrame] = {}
    buckets = marks = totals = None
    for n in range(1, longest + 1):
        counted = scratch.table(rows.mapInArrow(_count(n, longest, least, buckets, marks), COUNTED), f"counted-{n}")
        exact = counted.filter("slice is null")
        if n == 1:
            totals = scratch.table(exact.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent[n] = scratch.table(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), F.max("key").alias("key")).filter(F.col("f") >= least), f"frequent-{n}")
        if n < longest:
            with clean_shuffles(spark):
                buckets, marks = _full_buckets(counted, least), _frequent_keys(frequent[n])
        scratch.drop(counted)
    together = lambda tables: reduce(DataFrame.unionByName, tables)
    part = lambda a, size: F.array_join(F.slice("words", a, size), " ")
    held = lambda n: frequent[n].select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = lambda k, n: F.struct(F.lit(k).alias("k"), part(1, k).alias("first"), part(k + 1, n - k).alias("rest"))
    cuts = together([held(n).select("lang", "phrase", "a", F.explode(F.array(*(cut(k, n) for k in range(1, n)))).alias("c")) for n in range(2, longest + 1)])
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.first", "c.rest")
    parts = together([frequent[n].select("lang", "phrase", "f") for n in range(1, longest)])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    score = F.expr("(cast(1000000 as decimal(38,0)) * a_ * a_) div (l_ * r_)")
    scored = cuts.withColumns({"a_": wide("a"), "l_": wide("l"), "r_": wide("r")}).withColumn("score", score)
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    within = [held(n).select("lang", "a", F.explode(F.array(*(part(k + 1, m) for m in range(2, n) for k in range(n - m + 1)))).alias("phrase")) for n in range(3, longest + 1)]
    if within:
        longer = together(within).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        worst = worst.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (inside[1] * F.col("longer") < inside[0] * F.col("a")))
    kept = worst.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    # a language's first are sought in shares first, so that no task sorts all of a hot language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, text FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents)
), words AS (SELECT lang, regexp_extract_all(text, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, m, list_slice(w, k, k + m - 1) AS p
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM words, (VALUES (1), (2), (3)) AS lengths(m))
), f AS (SELECT lang, m, array_to_string(p, ' ') AS phrase, p, count(*) AS f FROM runs GROUP BY lang, m, p),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, p, f AS a FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT *, array_to_string(p[:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f)) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x AND l.m = c.k JOIN f r ON r.lang = c.lang AND r.phrase = c.y AND r.m = c.m - c.k
), worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) WHERE nth = 1),
inner_runs AS (SELECT lang, a, unnest([array_to_string(p[:2], ' '), array_to_string(p[2:], ' ')]) AS phrase FROM candidates WHERE m = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_runs GROUP BY lang, phrase),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank
  FROM worst w LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * w.a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
