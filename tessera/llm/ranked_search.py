"""Ranked lexical search as a blocked sparse matrix product.

Scores are C = A B: A holds for each item the multiplicity of its terms times their weight, B for each
term the int64 impact of each document. B is cut into blocks of documents, A into blocks of items, and a
tile multiplies one with a group of the other by Gustavson's method: an item's row of C is its terms'
rows of B, scaled and merged into an accumulator over the block's documents. A tile returns an item's
best k alone; a window reduces those of all tiles. All arithmetic is exact in 64-bit integers, but for the
weights' logarithm.

Terms are 64-bit hashes. Documents are read once: their blocks, of which only terms that a bitmap of the
items' terms (2 ** BITMAP_BITS bits whatever the sizes) may hold are kept, are a table, from which come
the corpus's counts and the products. Neither side is ever on the driver or in one task; a document or
an item is in one block, whatever its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language_model import squeeze, unsqueeze
from .shared import Scratch, clean_shuffles
from .words import PUNCTUATION, ranges, word_blocks

#: Text bytes of a block of documents, blocks of a tile, about, and (item, term) entries of a block of items, about.
BLOCK, TILE_BLOCKS, ITEM_ENTRIES = 1 << 20, 8, 1 << 18
BITMAP_BITS = 23
#: Cells of the accumulator and products that are merged at once, about.
CELLS, PRODUCTS = 1 << 22, 1 << 22


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, times) for each distinct term of each row."""
    for batch in batches:
        for first, last, words in word_blocks(batch.column(1), PUNCTUATION):
            owner = np.repeat(np.arange(last - first), words.counts())
            order = np.lexsort((words.hashes, owner))
            owner, terms = owner[order], words.hashes[order]
            fresh = np.ones(len(terms), bool)
            fresh[1:] = (terms[1:] != terms[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(fresh)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first).take(pa.array(owner[at])), pa.array(terms[at].view(np.int64)), pa.array(np.diff(np.append(at, len(terms))))], names=["item", "term", "times"]
            )


def _bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for each value of the terms' top BITMAP_BITS bits: at most 2 ** (BITMAP_BITS - 6) rows come to the driver."""
    slot = F.shiftrightunsigned("term", 64 - BITMAP_BITS)
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    found = terms.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _blocks(bitmap: np.ndarray):
    """Blocks of documents: ids, words of each, and by term (ascending) the documents that hold it and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last, words in word_blocks(batch.column(1), PUNCTUATION, limit=BLOCK):
                sizes = words.counts()
                owner = np.repeat(np.arange(last - first), sizes)
                slot = words.hashes >> np.uint64(64 - BITMAP_BITS)
                may = np.flatnonzero(bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                terms, at = np.unique(words.hashes[may], return_inverse=True)
                cells, times = np.unique(at * (last - first) + owner[may], return_counts=True)
                term, doc = np.divmod(cells, last - first)
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([int((sizes > 0).sum())], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), one(batch.column(0).slice(first, last - first).cast(pa.int64())),
                        pa.array([squeeze(sizes.astype(np.int64))], pa.binary()), one(pa.array(terms.view(np.int64))), one(pa.array(np.bincount(term, minlength=len(terms)).astype(np.int64))),
                        pa.array([squeeze(doc.astype(np.int32))], pa.binary()), pa.array([squeeze(times.astype(np.int64))], pa.binary()),
                    ],
                    names=["block", "n_docs", "n_words", "ids", "sizes", "terms", "df", "docs", "times"],
                )
                number += 1

    return run


BLOCKS = "block long, n_docs long, n_words long, ids array<long>, sizes binary, terms array<long>, df array<long>, docs binary, times binary"


def _pack_items(rows: pa.Table) -> pa.Table:
    """A block of items as one row: the distinct items, each one's bounds among the entries, and the entries' terms and scales."""
    rows = rows.sort_by([("item", "ascending"), ("term", "ascending")])
    coded = rows.column("item").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    first = np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes)).astype(np.int64)
    items = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    packed = [squeeze(first), squeeze(rows.column("term").to_numpy()), squeeze(rows.column("scale").to_numpy())]
    return pa.table([rows.column("i").slice(0, 1), items, *(pa.array([p], pa.binary()) for p in packed)], names=["i", "items", "first", "terms", "scales"])


def impacts(times: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Each posting's impact: (10**9 tf) div (1000 tf + 20 m), m = 100 - 50 + (50 n N) div L of its document."""
    m = np.array([50 + 50 * n * n_docs // n_words for n in sizes.tolist()], np.int64)  # 50 n N may pass 64 bits
    return (1_000_000_000 * times) // (1000 * times + 20 * m[docs])


def multiply(first: np.ndarray, terms: np.ndarray, scales: np.ndarray, b_terms: np.ndarray, b_first: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of C in chunks: (number of the first item, accumulator of items x documents)."""
    place = np.searchsorted(b_terms, terms)
    place[place == len(b_terms)] = 0
    held = b_terms[place] == terms if len(b_terms) else np.zeros(len(terms), bool)
    length = np.where(held, np.diff(b_first)[place] if len(b_terms) else 0, 0)
    work = np.concatenate([[0], np.cumsum(length)])[first]
    at, n_items = 0, len(first) - 1
    while at < n_items:
        end = min(at + max(1, CELLS // n_docs), n_items, max(at + 1, int(np.searchsorted(work, work[at] + PRODUCTS, "right")) - 1))
        entry = slice(first[at], first[end])
        some = np.flatnonzero(length[entry]) + first[at]
        row = np.repeat(np.arange(end - at), np.diff(first[at : end + 1]))[some - first[at]]
        posting = ranges(b_first[place[some]], length[some])
        sums = np.zeros((end - at) * n_docs, np.int64)
        np.add.at(sums, np.repeat(row * n_docs, length[some]) + docs[posting], np.repeat(scales[some], length[some]) * impact[posting])
        yield at, sums.reshape(end - at, n_docs)
        at = end


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best, by score and then the smaller document."""
    order = np.lexsort((doc, -score, item))
    item = item[order]
    opens = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(opens, np.diff(np.append(opens, len(item))))
    return order[rank < k]


def _tile(k: int, n_docs: int, n_words: int, kind: pa.DataType):
    def run(item_block: pa.Table, doc_blocks: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        best = (none, none, none)
        if item_block.num_rows and doc_blocks.num_rows:
            items = item_block.column("items").combine_chunks().flatten()
            first, terms = (unsqueeze(item_block.column(c)[0].as_py(), np.int64) for c in ("first", "terms"))
            terms, scales = terms.view(np.uint64), unsqueeze(item_block.column("scales")[0].as_py(), np.int64)
            for r in range(doc_blocks.num_rows):
                row = lambda c: doc_blocks.column(c)[r]  # noqa: B023, E731
                ids = row("ids").values
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                docs, times = unsqueeze(row("docs").as_py(), np.int32), unsqueeze(row("times").as_py(), np.int64)
                impact = impacts(times, unsqueeze(row("sizes").as_py(), np.int64), docs, n_docs, n_words)
                b_first = np.concatenate([[0], np.cumsum(row("df").values.to_numpy())]).astype(np.int64)
                found = [best]
                for at, sums in multiply(first, terms, scales, row("terms").values.to_numpy().view(np.uint64), b_first, docs, impact, len(ids)):
                    sums *= known
                    if sums.shape[1] > k:  # what is below an item's k-th score goes before anything is sorted
                        edge = np.partition(sums, sums.shape[1] - k, axis=1)[:, sums.shape[1] - k]
                        hit = (sums >= np.maximum(edge, 1)[:, None]).nonzero()
                    else:
                        hit = (sums > 0).nonzero()
                    mine = (hit[0] + at, ids[hit[1]], sums[hit])
                    keep = _best(*mine, k)
                    found.append(tuple(c[keep] for c in mine))
                best = tuple(np.concatenate(c) for c in zip(*found))
                keep = _best(*best, k)
                best = tuple(c[keep] for c in best)
            who = items.take(pa.array(best[0]))
        else:
            who = pa.array([], kind)
        return pa.table([who, pa.array(best[1]), pa.array(best[2])], names=["item", "doc", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, multiplicity: bool = False, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): each item's k documents of the highest score above 0, equal scores by ascending id.

    Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased; a null text has none.
    With `multiplicity` a term counts as often as the item holds it, else once. Rows that share an item id are one item with the
    terms of all; items without an id are ignored. Every row of `docs` is a document: repeated rows are ranked each (equal scores and
    ids, different ranks); rows without an id count in the corpus's statistics and are not ranked. Other columns are ignored. No documents,
    no items or no shared terms give no rows. A term of each document has weight 0 or more, so scores are never negative.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranked-search")
    kind = items.schema[item_col].dataType
    entries = items.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    entries = entries.mapInArrow(_item_terms, f"item {kind.simpleString()}, term long, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    entries = scratch.table(entries, "item-terms")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with clean_shuffles(spark):
        bitmap = _bitmap(entries)
    blocks = scratch.table(texts.mapInArrow(_blocks(bitmap), BLOCKS), "blocks")
    n_docs, n_words, n_blocks = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    held = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
    scaled = entries.join(held, "term").select("item", "term", (weight * (F.col("times") if multiplicity else 1)).alias("scale")).filter("scale > 0")
    scaled = scratch.table(scaled, "scaled")
    n_entries = scaled.count()
    i_blocks, groups = max(1, math.ceil(n_entries / ITEM_ENTRIES)), max(1, math.ceil(n_blocks / TILE_BLOCKS))
    packed = scaled.withColumn("i", F.expr(f"cast(pmod(xxhash64(item), {i_blocks}) as int)")).groupBy("i")
    packed = scratch.table(packed.applyInArrow(_pack_items, f"i int, items array<{kind.simpleString()}>, first binary, terms binary, scales binary"), "items")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.withColumn("g", copies(groups)).groupBy("i", "g")
    right = blocks.select(F.expr(f"cast(pmod(xxhash64(block), {groups}) as int)").alias("g"), "ids", "sizes", "terms", "df", "docs", "times").withColumn("i", copies(i_blocks)).groupBy("i", "g")
    value = items.select(item_col).limit(0).toArrow().schema.field(0).type
    found = left.cogroup(right).applyInArrow(_tile(k, n_docs, max(1, n_words), value), f"item {kind.simpleString()}, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


ORACLE = r"""
WITH words AS (
  SELECT rowid AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), postings AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY doc, term),
sizes AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
entries AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), weighted AS (
  SELECT item_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM entries JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) USING (term), corpus
), scored AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM weighted JOIN postings USING (term) JOIN sizes USING (doc), corpus WHERE doc_id IS NOT NULL GROUP BY item_id, doc
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
