"""Languages of a text by multilingual mixture inference.

A text is a bag of words, each drawn from one of the text's languages. What a language gives to a
word is the product of its bytes' n-gram probabilities, orders 1 to `ORDER` interpolated, read from
one table of hashed n-gram counts a language. The proportions of a set of languages are those of
greatest likelihood, found by expectation-maximisation over the text's words.

The set is chosen by penalised likelihood. It begins with the best single language (with the prior of
the training rows), and takes in the language along which the likelihood rises fastest as long as
that gains more than `penalty` times half the logarithm of the number of words. All texts of a block
climb side by side; a word that a block holds many times is looked up once.

Counts are learned from a sample whose expected size is a parameter, spread over tasks, so the model's
size depends on the number of languages alone: 4 * SLOTS bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BLOCK_BYTES, SPACES, Words, blocks, mix, ranges, text_bytes

#: Longest n-gram in bytes (of UTF-8) and entries of a language's table of counts.
ORDER, SLOTS = 5, 1 << 17
#: Training texts of a language that are counted, in expectation; languages of the most training texts that are learned.
SAMPLE, LANGUAGES = 2000, 128
#: Tasks that count the sample.
TASKS = 8
#: Bytes after which a run of letters (of a script without spaces, say) is cut into another word.
LONGEST_WORD = 48
#: Weight of the lower orders against seen n-grams, by order.
BACKOFF = 8.0
#: Price of another language, in halves of the logarithm of the number of words.
PENALTY = 6.0
UNKNOWN = "und"


def letters(texts: pa.Array) -> pa.Array:
    """Texts of lower-case words of letters and marks alone, one space between them; texts without a letter are empty."""
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.match_substring_regex(texts, r"\p{L}"), texts, "")
    return pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+", " ")


class Units:
    """The words of a block of texts of `letters`: the distinct ones' bytes and which text holds which, how often."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        words = Words(raw, bounds, SPACES, lower=False)
        pieces = -(-(words.ends - words.starts) // LONGEST_WORD)
        starts = np.repeat(words.starts, pieces) + ranges(np.zeros(len(pieces), np.int64), pieces) * LONGEST_WORD
        ends = np.minimum(starts + LONGEST_WORD, np.repeat(words.ends, pieces))
        text = np.repeat(np.repeat(np.arange(words.n_texts), words.counts()), pieces)
        hashes = np.repeat(words.hashes, pieces)
        later = np.repeat(pieces, pieces) > 1
        hashes[later] = mix(hashes[later] + np.uint64(0x9E3779B97F4A7C15) * (ranges(np.zeros(len(pieces), np.int64), pieces)[later] + 1).astype(np.uint64))
        _, at, word, self.times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.raw, self.starts, self.ends = raw, starts[at], ends[at]
        pair = text * max(1, len(at)) + word
        pair, self.counts = np.unique(pair, return_counts=True)
        self.text, self.word = np.divmod(pair, max(1, len(at)))
        self.first = np.searchsorted(self.text, np.arange(words.n_texts + 1))
        self.n_texts = words.n_texts

    def grams(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each order from 0, the slot of the n-gram that ends at each byte of the distinct words, the space after a word included, and the word of each byte.

        The space before a word is its first byte's history; where a word has not begun so many bytes ago the longest history stands for longer ones.
        Order 0 is the slot of no bytes.
        """
        lengths = self.ends - self.starts + 2
        ends = np.cumsum(lengths)
        flat = np.full(ends[-1] if len(ends) else 0, 32, np.uint8)
        inner = ranges(ends - lengths + 1, lengths - 2)
        flat[inner] = self.raw[ranges(self.starts, lengths - 2)]
        place = ranges(np.zeros(len(lengths), np.int64), lengths)
        packed = np.zeros(len(flat), np.uint64)
        slots = [np.full(len(flat), _slot(np.zeros(1, np.uint64))[0])]
        for n in range(1, ORDER + 1):
            back = np.zeros(len(flat), np.uint64)
            if len(flat) >= n:
                back[n - 1 :] = flat[: len(flat) - n + 1]
            inside = place >= n - 1
            packed = np.where(inside, packed | (back + np.uint64(1)) << np.uint64(9 * (n - 1)), packed)
            slots.append(_slot(packed))
        return slots, place, np.repeat(np.arange(len(lengths)), lengths)


def _slot(packed: np.ndarray) -> np.ndarray:
    return (mix(packed + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def count_grams(texts: pa.Array) -> np.ndarray:
    """Counts of all n-grams of the texts by slot."""
    out = np.zeros(SLOTS, np.int64)
    raw, bounds = text_bytes(letters(texts))
    for a, b in blocks(bounds):
        units = Units(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        slots, place, word = units.grams()
        times = units.times[word]
        for n in range(1, ORDER + 1):
            whole = place >= n - 1  # a byte nearer to its word's start has no n-gram of this order
            out += np.bincount(slots[n][whole], times[whole], SLOTS).astype(np.int64)
        # the bytes that have a history: all but the space before the word
        out[slots[0][0] if len(slots[0]) else 0] += int(times[place > 0].sum())
    return out


@dataclass
class Model:
    """Learned languages in ascending order, counts (SLOTS, languages) of their n-grams, and shares of the training rows."""

    names: list[str]
    counts: np.ndarray
    prior: np.ndarray
    penalty: float = PENALTY

    def word_likelihoods(self, units: Units) -> np.ndarray:
        """ln P(word | language) of each distinct word."""
        slots, place, word = units.grams()
        out = np.zeros((len(units.starts), len(self.names)))
        for a in range(0, len(place), 1 << 18):
            some = slice(a, a + (1 << 18))
            p = np.full((len(place[some]), len(self.names)), 1 / 256)
            for n in range(1, ORDER + 1):
                seen = self.counts[slots[n][some]]
                # the history is the n-gram one shorter that ends a byte before
                before = slots[n - 1][np.maximum(np.arange(a, a + len(p)) - 1, 0)]
                history = np.maximum(self.counts[before], seen)
                better = (seen + BACKOFF * p) / (history + BACKOFF)
                p = np.where((place[some] >= n - 1)[:, None] if n > 1 else True, better, p)
            p[place[some] == 0] = 1.0
            np.add.at(out, word[some], np.log(p))
        return out

    def proportions(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the share of its words in each language of its set (0 of others), and the share that each language explains when all are allowed a word."""
        n_texts, k = units.n_texts, len(self.names)
        share, explained = np.zeros((n_texts, k)), np.zeros((n_texts, k))
        some = np.flatnonzero(np.diff(units.first))
        if not len(some) or not k:
            return share, explained
        first = units.first[some]
        owner = np.repeat(np.arange(len(some)), np.diff(units.first)[some])
        logs = self.word_likelihoods(units)
        top = logs.max(axis=1)[units.word]
        like = np.exp(np.maximum(logs[units.word] - top[:, None], -50.0))
        weight = units.counts.astype(np.float64)
        size = np.add.reduceat(weight, first)
        gather = lambda x: np.add.reduceat(x, first, axis=0)
        single = gather(weight[:, None] * np.log(like)) + np.log(self.prior)
        chosen = np.zeros((len(some), k), bool)
        chosen[np.arange(len(some)), single.argmax(axis=1)] = True
        theta = chosen.astype(np.float64)
        density = np.einsum("ij,ij->i", theta[owner], like)
        value = gather(weight * np.log(density))
        climbing = np.ones(len(some), bool)
        while climbing.any() and k > 1:
            slope = np.where(chosen, -np.inf, gather(weight[:, None] * like / density[:, None]))
            wider = chosen.copy()
            wider[np.arange(len(some)), slope.argmax(axis=1)] = True
            climbing &= slope.max(axis=1) > size
            at = np.flatnonzero(climbing)
            if not len(at):
                break
            rows = np.flatnonzero(climbing[owner])
            inner = np.cumsum(np.diff(np.append(first, len(owner)))[at])
            new_theta, new_value = _climb(like[rows], weight[rows], np.concatenate([[0], inner]), wider[at])
            gain = new_value - value[at] > self.penalty / 2 * np.log(np.maximum(size[at], 2))
            climbing[at[~gain]] = False
            won = at[gain]
            theta[won], value[won], chosen[won] = new_theta[gain], new_value[gain], wider[won]
            density = np.einsum("ij,ij->i", theta[owner], like)
        share[some] = theta
        open_theta = (theta * size[:, None] + 1) / (size + k)[:, None]
        parts = open_theta[owner] * like
        explained[some] = gather(weight[:, None] * parts / parts.sum(axis=1, keepdims=True)) / size[:, None]
        return share, explained


def _climb(like: np.ndarray, weight: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 60, least: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of greatest likelihood within each text's allowed languages, by expectation-maximisation, and the log-likelihood."""
    owner = np.repeat(np.arange(len(allowed)), np.diff(first))
    theta = allowed / allowed.sum(axis=1, keepdims=True)
    size = np.add.reduceat(weight, first[:-1])
    for _ in range(rounds):
        parts = theta[owner] * like
        parts *= (weight / parts.sum(axis=1))[:, None]
        new = np.add.reduceat(parts, first[:-1], axis=0) / size[:, None]
        moved, theta = np.abs(new - theta).max(), new
        if moved < least:
            break
    return theta, np.add.reduceat(weight * np.log(np.einsum("ij,ij->i", theta[owner], like)), first[:-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of a task's sample: its counts, compressed."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in pc.unique(batch.column(0)):
            mine = batch.column(1).filter(pc.equal(batch.column(0), lang))
            sums[lang.as_py()] = sums.get(lang.as_py(), 0) + count_grams(mine)
    if sums:
        yield _packed(list(sums), list(sums.values()))


def _packed(names: list[str], counts: list[np.ndarray]) -> pa.RecordBatch:
    squeezed = [zstandard.ZstdCompressor(level=1).compress(c.astype(np.uint32).tobytes()) for c in counts]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(squeezed, pa.binary())], names=["lang", "counts"])


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32).astype(np.int64)


def _added(rows: pa.Table) -> pa.Table:
    total = sum(_unpacked(c) for c in rows.column("counts").to_pylist())
    return pa.Table.from_batches([_packed([rows.column("lang")[0].as_py()], [total])])


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY) -> Model:
    """The model of the rows that have a language and whose id's crc32 modulo 5 is not 0; rows without an id do not teach.

    Of each language, rows are taken by a hash of their id so that `sample` are expected, and each of their distinct texts
    counts once. Only the `languages` with the most rows are learned; ties go to the smaller name. Rows of null or
    letterless text teach their language's prior alone. Without rows there are no languages.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.crc32(F.col("id").cast("string")) % 5 != 0))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([], np.zeros((SLOTS, 0)), np.zeros(0), penalty)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))[F.col("lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text").distinct()
    counted = chosen.repartition(TASKS, "text").mapInArrow(_counted, "lang string, counts binary")
    found = {r.lang: _unpacked(r.counts) for r in counted.groupBy("lang").applyInArrow(_added, "lang string, counts binary").collect()}  # a row for each language
    names = sorted(sizes)
    counts = np.stack([found.get(x, np.zeros(SLOTS, np.int64)) for x in names], axis=1).astype(np.float32)
    return Model(names, counts, np.array([sizes[x] for x in names], float) / sum(sizes.values()), penalty)


def _predicted(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, bounds = text_bytes(letters(texts))
    for a, b in blocks(bounds, BLOCK_BYTES):
        yield a, b, *model.proportions(Units(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: id, held_out, lang_pred, score, and the text's languages with their proportions, largest first.

    lang_pred is the language of the largest proportion, ties to the smaller name; score is the share of the text's words
    that it explains when every learned language is allowed one word besides the proportions, so that short and ambiguous texts
    score lower. A text that is null or has no letter, and any text when nothing was learned, is `und` with score 0 and no
    languages. held_out is whether crc32 of the id as text is 0 modulo 5 (null for a null id). Texts are read whole; repeated rows
    are judged alike; other columns are ignored; an empty table gives no rows.
    """
    names = np.array(model.names, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, langs, shares = [], [], [], []
            for a, b, share, explained in _predicted(model, batch.column(1)):
                best = share.argmax(axis=1) if len(names) else np.zeros(b - a, int)
                for i in range(b - a):
                    in_set = np.flatnonzero(share[i] > 0)
                    if not len(in_set):
                        pred.append(UNKNOWN), score.append(0.0), langs.append([]), shares.append([])
                        continue
                    in_set = in_set[np.argsort(-share[i][in_set], kind="stable")]
                    pred.append(names[best[i]])
                    score.append(float(min(1.0, explained[i][best[i]])))
                    langs.append(names[in_set].tolist())
                    shares.append(share[i][in_set].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["id", "lang_pred", "score", "languages", "proportions"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(run, "id long, lang_pred string, score double, languages array<string>, proportions array<double>")
    return found.select(F.col("id").alias(id_col), (F.crc32(F.col("id").cast("string")) % 5 == 0).alias("held_out"), "lang_pred", "score", "languages", "proportions")
