"""Cost-balanced packing of token ids into sequences.

A document's piece of n tokens costs LINEAR * n + QUADRATIC * n * n (attention stays within a
piece). Documents longer than a sequence give whole sequences and a rest. Rests and shorter
documents, in descending order, go to the lowest-cost sequence in which they fit; one that fits
nowhere is cut over the lowest-cost sequences that have room. As many sequences are opened as the
tokens need, so that a window of documents wastes less than one sequence.

Windows are bounded runs of documents of one partition of the input: no text is moved, and a lost
task makes the same sequences again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder, with_end

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens of documents that are packed together.
WINDOW_TOKENS = 4 << 20


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and each sequence's cost."""
    pieces: list[tuple[int, int, int, int, int]] = []
    n_full = 0
    rests = []
    for d, n in enumerate(lengths.tolist()):
        full, rest = divmod(n, capacity)
        for k in range(full):
            pieces.append((d, k * capacity, capacity, n_full, 0))
            n_full += 1
        if rest:
            rests.append((rest, d, full * capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    n_open = -(-sum(r[0] for r in rests) // capacity)
    filled, costs = np.zeros(n_open, np.int64), np.zeros(n_open)
    blocked = np.full(n_open, np.inf)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, n_full + s, int(filled[s])))
        filled[s] += n
        costs[s] += cost(n)

    for n, d, start in rests:
        fits = np.where(filled + n <= capacity, costs, blocked)
        s = int(fits.argmin())
        if filled[s] + n <= capacity:
            put(d, start, n, s)
            continue
        while n:
            s = int(np.where(filled < capacity, costs, blocked).argmin())
            part = min(n, capacity - int(filled[s]))
            put(d, start, part, s)
            start, n = start + part, n - part
    return pieces, np.concatenate([np.full(n_full, cost(capacity)), costs])


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def _packer(definition: str, capacity: int, end_id: int, with_ids: bool):
    def emit(ids: list, counts: list, tokens: list, first_sequence: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.concatenate(counts)
        flat = np.ascontiguousarray(np.concatenate(tokens), "<u4")
        begins = np.cumsum(lengths) - lengths
        pieces, costs = pack(lengths, capacity)
        table = np.array(pieces, np.int64).reshape(-1, 5)
        d, start, length, sequence, offset = table.T
        at = begins[d] + start
        view = memoryview(flat).cast("B")
        crcs = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(at))
        owners = pa.concat_arrays(ids).take(pa.array(d))
        columns = [owners, start, length, crcs, lengths[d], sequence + first_sequence, offset, costs[sequence]]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"]
        if with_ids:
            order = np.repeat(at - (np.cumsum(length) - length), length) + np.arange(length.sum())
            bounds = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            columns.append(pa.ListArray.from_arrays(bounds, pa.array(flat[order].astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names), first_sequence + len(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition).encode
        sequence = TaskContext.get().partitionId() << 32
        ids, counts, tokens, held = [], [], [], 0
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for first, flat, sizes in encode(batch.column(1)):
                flat, sizes = with_end(flat, sizes, end_id)
                ids.append(keys.slice(first, len(sizes)))
                counts.append(sizes)
                tokens.append(flat)
                held += len(flat)
                if held >= WINDOW_TOKENS:
                    out, sequence = emit(ids, counts, tokens, sequence)
                    yield out
                    ids, counts, tokens, held = [], [], [], 0
        if held:
            yield emit(ids, counts, tokens, sequence)[0]

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, start in its document, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_cost and (`with_ids`) its ids.

    A document is the tokenizer's ids of the whole text, then `end_id`; null and empty texts are the end
    id alone. `start` counts the document's ids before the piece, `offset` the sequence's. Documents of
    one cost keep the input's order. Rows that share an id are documents of their own, null ids stay null.
    A very long text gives whole sequences and a rest. An empty table gives no pieces; other columns are ignored. sequence_id is the input's partition
    in the upper 32 bits and a number in it; sequences are to be padded to `capacity`.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_packer(definition, capacity, end_id, with_ids), schema)
    return out.withColumnRenamed("doc_id", id_col)
