"""Language-model scores by a weighted backoff automaton.

Model. Orders 1 to `order` are interpolated: p(w|h) = (1 - b) c(hw)/c(h) + b p(w|h'), where h' is h
without its first word and the backoff mass b depends on c(h): it is the share of words that were
new after histories of count c(h) + 1 when each training word is left out in turn. The lowest order is
(c(w) + 0.5) / (N + 0.5 (V + 1)). As an automaton: a state is a history, an arc a seen n-gram with
its log-probability, and a failure arc leads from a history to the shorter one at weight log b.

Scale. The model grows with the corpus and is never in one place. Documents are cut into bounded
chunks of encoded words. A chunk sends the distinct n-grams it needs, with its own training counts,
to partitions by hash, as sorted packed blocks, one order after the other; a partition adds them up
and answers each chunk with the corpus totals in the order asked. A chunk meets its answers twice:
once for the sums behind the backoff masses, once for its scores. For these it holds the part of
the automaton its own documents can reach and walks them through it from left to right, all in step.
A long document walks in stretches, each of which begins in the state that the words before it lead to.
The shuffles of a step go once it is written, so disk holds chunks, answers and one shuffle at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, clean_shuffles
from .words import mix, ranges, word_blocks

ORDER = 3
#: Words of a chunk, about, and of the n-grams that meet in a partition, about.
CHUNK_TOKENS, PARTITION_TOKENS = 3 << 18, 3 << 19
#: Words that are walked one after the other; stretches walk side by side.
STRETCH = 256
START, END = mix(np.array([1, 2], np.uint64))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Classes of a history's count: exact up to 16, then by powers of two.
CLASSES = 80
FOLDS, HELD_OUT = 5, 1


def classes(counts: np.ndarray) -> np.ndarray:
    counts = np.asarray(counts, np.int64)
    return np.where(counts <= 16, counts, 13 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)).clip(0, CLASSES - 1)


def squeeze(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    rows = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rows.T).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


class Grams:
    """n-gram keys of every position of a chunk's word sequence (each document's words, then END)."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, order: int):
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        opens = self.first[:-1]
        self.starts = [np.uint64(0), START]
        self.keys = [None, words & _EVEN]
        whole = words
        for n in range(2, order + 1):
            before = np.empty_like(words)
            before[1:] = whole[:-1]
            before[opens] = self.starts[n - 1]
            whole = mix(before * _STEP + words)
            self.keys.append(whole & _EVEN)
            self.starts.append(mix(np.array([self.starts[n - 1]]) * _STEP + START)[0])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, sizes, words, held = [], [], [], 0
    names = ["chunk", "ids", "sizes", "vocabulary", "tokens"]

    def flush() -> pa.RecordBatch:
        vocabulary, local, counts = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
        rank = np.argsort(-counts, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        keys, size = pa.concat_arrays(ids), np.concatenate(sizes)
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(keys), one(pa.array(size, pa.int64())), pa.array([squeeze(vocabulary[rank])], pa.binary()), pa.array([squeeze(place[local].astype(np.uint32))], pa.binary())], names=names
        )

    for batch in batches:
        own = batch.column(0).cast(pa.int64())
        for first, last, block in word_blocks(batch.column(1)):
            counts = block.counts()
            ids.append(own.slice(first, last - first))
            sizes.append(counts + 1)
            words.append(np.insert(block.hashes, np.cumsum(counts), END))
            held += len(words[-1])
            if held >= CHUNK_TOKENS:
                yield flush()
                number, ids, sizes, words, held = number + 1, [], [], [], 0
    if held:
        yield flush()


CHUNK = "chunk long, ids array<long>, sizes array<long>, vocabulary binary, tokens binary"


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 5, is 1; a document without an id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _open(row: dict, order: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """A chunk's n-grams, its words' hashes, and which documents are held out."""
    vocabulary = unsqueeze(row["vocabulary"], np.uint64)
    words = vocabulary[unsqueeze(row["tokens"], np.uint32)]
    return Grams(words, np.array(row["sizes"], np.int64), order), words, np.array([held_out(d) for d in row["ids"]], bool)


def _asks(n: int, partitions: int):
    """A chunk's distinct n-grams of order n and their training counts in it, a block for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, _, held = _open(row, n)
                marked = grams.keys[n] | np.repeat(~held, np.diff(grams.first)).astype(np.uint64)
                marked.sort()
                keys = marked & _EVEN
                at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts = np.add.reduceat(marked & np.uint64(1), at).astype(np.uint32)
                keys = keys[at]
                edges = np.searchsorted(_part(keys, partitions), np.arange(partitions + 1))
                some = np.flatnonzero(np.diff(edges))
                blocks = [(squeeze_sorted(keys[edges[p] : edges[p + 1]]), squeeze(counts[edges[p] : edges[p + 1]])) for p in some.tolist()]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([n] * k, pa.int32()), pa.array([row["chunk"]] * k, pa.int64()), pa.array([b[0] for b in blocks], pa.binary()), pa.array([b[1] for b in blocks], pa.binary())],
                    names=["part", "n", "chunk", "keys", "counts"],
                )

    return run


def _part(keys: np.ndarray, partitions: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def _answers(rows: pa.Table) -> pa.Table:
    """Corpus totals for the blocks of one partition and order; a key's first asker is told so by a mark (lowest bit)."""
    rows = rows.sort_by("chunk")
    keys = [unsqueeze_sorted(k) for k in rows.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    flat = np.concatenate(keys)
    counts = np.concatenate([unsqueeze(c, np.uint32) for c in rows.column("counts").to_pylist()]).astype(np.uint64)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(fresh)
    totals = np.add.reduceat(counts[order], at)
    out = np.empty(len(flat), np.uint64)
    out[order] = np.repeat(totals, np.diff(np.append(at, len(flat)))) << np.uint64(1) | fresh.astype(np.uint64)
    ends = np.cumsum(sizes)
    blocks = [squeeze(out[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
    known = int(np.count_nonzero(totals))
    return pa.table({
        "chunk": rows.column("chunk"), "n": rows.column("n"), "part": rows.column("part"), "totals": pa.array(blocks, pa.binary()),
        "known": pa.array([known] + [0] * (len(blocks) - 1), pa.int64()), "added": pa.array([int(totals.sum())] + [0] * (len(blocks) - 1), pa.int64()),
    })


class Tables:
    """For each order the chunk's distinct n-grams, ascending: a position of each, totals, first-asker marks, and each position's place among them."""

    def __init__(self, grams: Grams, blocks: dict[int, list[bytes]], order: int):
        self.position, self.total, self.first_asker, self.place = ([None] for _ in range(4))
        for n in range(1, order + 1):
            by = np.argsort(grams.keys[n])
            ordered = grams.keys[n][by]
            fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            at = np.flatnonzero(fresh)
            place = np.empty(len(by), np.int32)
            place[by] = np.cumsum(fresh) - 1
            marked = np.concatenate([unsqueeze(b, np.uint64) for b in blocks[n]])
            assert len(marked) == len(at), "answers do not match what the chunk asked"
            self.position.append(by[at].astype(np.int32))
            self.place.append(place)
            self.total.append((marked >> np.uint64(1)).astype(np.int64))
            self.first_asker.append((marked & np.uint64(1)).astype(bool))

    def history_total(self, grams: Grams, n: int, documents: int) -> np.ndarray:
        """For each distinct n-gram of order n > 1, its history's count in training."""
        at = self.position[n]
        opens = np.zeros(grams.first[-1], bool)
        opens[grams.first[:-1]] = True
        return np.where(opens[at], documents, self.total[n - 1][self.place[n - 1][at - 1]])


def _met(chunks: pa.Table, answers: pa.Table, order: int) -> tuple[dict, Grams, np.ndarray, Tables]:
    """A chunk's row, n-grams, held-out marks and tables, with its answers."""
    answers = answers.sort_by([("n", "ascending"), ("part", "ascending")]).select(["n", "totals"]).to_pydict()
    (row,) = chunks.to_pylist()
    blocks: dict[int, list[bytes]] = {n: [] for n in range(1, order + 1)}
    for n, block in zip(answers["n"], answers["totals"]):
        blocks[n].append(block)
    grams, _, held = _open(row, order)
    return row, grams, held, Tables(grams, blocks, order)


def _sums(order: int, documents: int):
    """What a chunk's first-asked n-grams say on backoff masses: words and single n-grams by order and class of history."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        _, grams, _, tables = _met(chunks, answers, order)
        words, singles = np.zeros((2, order + 1, CLASSES), np.int64)
        for n in range(2, order + 1):
            of = classes(tables.history_total(grams, n, documents))
            own = tables.first_asker[n] & (tables.total[n] > 0)
            words[n] = np.bincount(of[own], tables.total[n][own], CLASSES).astype(np.int64)
            singles[n] = np.bincount(of[own & (tables.total[n] == 1)], minlength=CLASSES)
        return pa.table({"at": pa.array(np.arange(words.size), pa.int32()), "words": words.ravel(), "singles": singles.ravel()})

    return run


def backoff_masses(words: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """b for each order and class of c(h), from words and singly seen n-grams after histories of each class: that of the next count up."""
    share = (singles + 0.5) / (words + 1.0)
    ahead = classes(np.concatenate([np.arange(17) + 1, 2 ** (np.arange(17, CLASSES) - 13).clip(0, 62) + 1]))
    return np.clip(share[:, ahead], 1e-4, 1 - 1e-4)


class Automaton:
    """The part of the model that a chunk can reach.

    Level n holds the seen n-grams: as arcs, each with its log-probability `weight[n]` after its
    history; as states, each with the weight `failure[n]` of the failure arc to its suffix.
    `arc[n]` is the arc of level n that each of the chunk's positions would take, -1 where there is none;
    taken or not, it is the state of that level in which the position ends.
    """

    def __init__(self, grams: Grams, tables: Tables, order: int, n_tokens: int, n_types: int, documents: int, masses: np.ndarray):
        self.order, self.first = order, grams.first
        self.unknown = float(np.log10(0.5 / (n_tokens + 0.5 * (n_types + 1))))
        unigram = np.log10((tables.total[1] + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
        self.base, self.known = unigram, tables.total[1] > 0
        self.arc, self.weight, self.failure, self.start_failure = [None], [None], [None], [0.0]
        every = [None, unigram]
        for n in range(1, order + 1):
            seen = tables.total[n] > 0
            if n > 1:
                histories = tables.history_total(grams, n, documents)
                b = masses[n][classes(histories)]
                lower = every[n - 1][tables.place[n - 1][tables.position[n]]]
                with np.errstate(divide="ignore"):
                    every.append(np.log10((1 - b) * tables.total[n] / np.maximum(histories, 1) + b * 10.0**lower))
            self.arc.append(np.where(seen, np.cumsum(seen) - 1, -1).astype(np.int32)[tables.place[n]])
            # a last entry of 0 is what place -1 finds
            self.weight.append(np.append(every[n][seen], 0.0))
            self.failure.append(np.append(np.log10(masses[n + 1][classes(tables.total[n][seen])]), 0.0) if n < order else None)
            self.start_failure.append(float(np.log10(masses[n + 1][classes(np.array([documents]))[0]])) if n < order and documents else 0.0)

    def walk(self, stretch: int = STRETCH) -> np.ndarray:
        """log10 probability of each document: all walk from left to right in step, each carrying its state's failure weights."""
        pieces = -(-np.diff(self.first) // stretch)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        begins = self.first[owner] + ranges(np.zeros(len(pieces), np.int64), pieces) * stretch
        lengths = np.minimum(stretch, self.first[owner + 1] - begins)
        by = np.argsort(-lengths, kind="stable")
        begins, lengths, owner = begins[by], lengths[by], owner[by]
        opens = begins == self.first[owner]
        # the failure weight of the state of each level that a stretch begins in, 0 where it is no state
        leave = [np.zeros(0)] + [np.where(opens, self.start_failure[n], self.failure[n][self.arc[n][begins - 1]]) for n in range(1, self.order)]
        total = np.zeros(len(by))
        active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        for t, k in enumerate(active.tolist()):
            arcs = [None] + [self.arc[n][begins[:k] + t] for n in range(1, self.order + 1)]
            gain, free = np.zeros(k), np.ones(k, bool)
            for n in range(self.order, 0, -1):
                gain += self.weight[n][arcs[n]] * free
                free &= arcs[n] < 0
                gain += (leave[n - 1][:k] if n > 1 else self.unknown) * free
            total[:k] += gain
            for n in range(1, self.order):
                leave[n][:k] = self.failure[n][arcs[n]]
        return np.bincount(owner, total, len(pieces))


def _scored(order: int, n_tokens: int, n_types: int, documents: int, masses: np.ndarray):
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        row, grams, held, tables = _met(chunks, answers, order)
        automaton = Automaton(grams, tables, order, n_tokens, n_types, documents, masses)
        place = tables.place[1]
        sums = lambda x: np.add.reduceat(x[place], grams.first[:-1])
        n = np.diff(grams.first)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(held), "n_tokens": n, "n_known": sums(automaton.known.astype(np.int64)),
            "train_tokens": np.full(len(n), n_tokens), "base_score": sums(automaton.base), "score": automaton.walk(),
        })

    return run


def score_documents(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of `docs`, whole texts.

    Learns from the rows whose id's crc32 (as text) modulo 5 is not 1; rows without an id are learned
    from and keep null. Words are separated by ASCII white space, A-Z lower-cased, and each document
    ends in one end word; a null or empty text is that word alone. base_score is the lowest order
    alone. Repeated rows count each. Other columns are ignored; an empty table gives no rows. If all
    rows are held out, nothing is known and scores are base scores.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = scratch.table(rows.mapInArrow(_chunks, CHUNK), "chunks")
    learns = f"not (doc_id is not null and crc32(cast(doc_id as string)) % {FOLDS} = {HELD_OUT})"
    each = chunks.select(F.explode(F.arrays_zip("ids", "sizes")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("size"))
    tokens, documents = each.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.expr(learns))).first()
    partitions = max(1, -(-tokens // PARTITION_TOKENS))
    asks, said = "part int, n int, chunk long, keys binary, counts binary", "chunk long, n int, part int, totals binary, known long, added long"
    answers = None
    for n in range(1, order + 1):
        some = scratch.table(chunks.mapInArrow(_asks(n, partitions), asks).groupBy("part").applyInArrow(_answers, said), f"answers-{n}")
        answers = some if answers is None else answers.union(some)
    n_types, n_tokens = answers.filter("n = 1").agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("added"), F.lit(0))).first()
    both = chunks.groupBy("chunk").cogroup(answers.select("chunk", "n", "part", "totals").groupBy("chunk"))
    words, singles = np.zeros((2, (order + 1) * CLASSES))
    with clean_shuffles(spark):
        for at, w, s in both.applyInArrow(_sums(order, documents), "at int, words long, singles long").groupBy("at").agg(F.sum("words"), F.sum("singles")).collect():  # a row for each order and class
            words[at], singles[at] = w, s
    masses = backoff_masses(words.reshape(-1, CLASSES), singles.reshape(-1, CLASSES))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.applyInArrow(_scored(order, n_tokens, n_types, documents, masses), schema).withColumnRenamed("doc_id", id_col)
