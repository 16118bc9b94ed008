"""Token-id files: ids in fixed-size blocks, transposed into bit (or byte) planes, each plane zstandard.

A file is a run of segments, each followed by a line feed. A segment:

    b"TIDP"  u32 version  u64 length of the segment  u64 n_docs  u64 n_ids  u32 block  u32 planes' kind  u64 index bytes
    index, zstandard: i64 doc ids, u8 whether the id is null, u64 ids of each document,
        for each chunk: u64 place, u32 ids, u32 number of planes, then u32 bytes of each plane
    planes of all chunks

All numbers are little-endian. A chunk keeps the planes up to its largest id's highest bit (byte), so
small ids take few. Segments are bounded in ids, so writers hold one at a time, and a chunk can be
read alone by its place. A file ends after FILE_SEGMENTS segments, some 60 MB, so that readers, which
get a file as one value, hold that much. (A text of more ids than a segment's makes a longer one.)

Files are written by Spark's own committer (a text file without encoding), so they go to any store,
whole or not at all, and are read again as binary files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch
from .tokens import encoder, with_end

MAGIC, VERSION = b"TIDP", 1
HEAD = struct.Struct("<4sIQQQIIQ")
BLOCK = 1 << 16
SEGMENT_IDS, FILE_SEGMENTS = 4 << 20, 8
BITS, BYTES = 1, 8


def planes_of(ids: np.ndarray, kind: int = BITS) -> list[bytes]:
    """Planes of a chunk, lowest first, as many as its largest id needs."""
    n = -(-int(ids.max()).bit_length() // kind) if len(ids) else 0
    if kind == BYTES:
        rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(n)]
    rows = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(n)]


def ids_of(planes: list[bytes], n: int, kind: int = BITS) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        if kind == BITS:
            part = np.unpackbits(part, bitorder="little", count=n)
        out |= part.astype(np.uint32) << np.uint32(k * kind)
    return out


def encode_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, kind: int = BITS, level: int = 3) -> bytes:
    pack = zstandard.ZstdCompressor(level=level).compress
    chunks, body, place = [], [], 0
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        planes = [pack(p) for p in planes_of(part, kind)]
        chunks.append(struct.pack(f"<QII{len(planes)}I", place, len(part), len(planes), *map(len, planes)))
        body += planes
        place += sum(map(len, planes))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    index = pack(keys.tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.ascontiguousarray(counts, "<u8").tobytes() + b"".join(chunks))
    head = HEAD.pack(MAGIC, VERSION, HEAD.size + len(index) + place, len(doc_ids), len(ids), block, kind, len(index))
    return b"".join([head, index, *body])


def decode_segment(data: memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc ids, ids of each, all ids, bytes of the segment) of the segment at the start of `data`."""
    magic, version, length, n_docs, n_ids, _, kind, index_bytes = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id segment")
    unpack = zstandard.ZstdDecompressor().decompress
    index = unpack(bytes(data[HEAD.size : HEAD.size + index_bytes]))
    keys = np.frombuffer(index, "<i8", n_docs)
    null = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    counts = np.frombuffer(index, "<u8", n_docs, 9 * n_docs).astype(np.int64)
    at, body, out = 17 * n_docs, HEAD.size + index_bytes, []
    while at < len(index):
        place, n, n_planes = struct.unpack_from("<QII", index, at)
        sizes = struct.unpack_from(f"<{n_planes}I", index, at + 16)
        at += 16 + 4 * n_planes
        ends = np.cumsum((body + place, *sizes))
        out.append(ids_of([unpack(bytes(data[a:b])) for a, b in zip(ends, ends[1:])], n, kind))
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    assert len(ids) == n_ids
    return [None if x else int(k) for k, x in zip(keys.tolist(), null.tolist())], counts, ids, length


def _segments(definition: str, end_id: int, block: int, kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(definition).encode
        keys, counts, tokens, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            data = encode_segment(keys, np.concatenate(counts), np.concatenate(tokens), block, kind)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, flat, sizes in encode(batch.column(1)):
                flat, sizes = with_end(flat, sizes, end_id)
                keys += own[first : first + len(sizes)]
                counts.append(sizes)
                tokens.append(flat)
                held += len(flat)
                if held >= SEGMENT_IDS:
                    yield flush()
                    keys, counts, tokens, held = [], [], [], 0
        if keys:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, kind: int = BITS) -> None:
    """Write the ids of every text, an end id after each, in ascending order of id (null first), to files under `path`.

    Null and empty texts are the end id alone; rows that share an id follow each other, in order of text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_segments(definition, end_id, block, kind), "segment binary").select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def segments_of(content) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    view, at = memoryview(content).cast("B"), 0
    while at < len(view):
        keys, counts, ids, length = decode_segment(view[at:])
        yield keys, counts, ids
        at += length + 1


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                before = row = 0
                for keys, counts, ids in segments_of(content.as_buffer()):
                    flat = np.ascontiguousarray(ids, "<u4")
                    ends = np.cumsum(counts)
                    view = memoryview(flat).cast("B")
                    crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                    n = len(keys)
                    columns = [pa.array([name.as_py()] * n), pa.array(np.arange(row, row + n)), pa.array(keys, pa.int64()), pa.array(before + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                    names = ["file", "row", "doc_id", "start_in_file", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    before, row = before + int(ends[-1]) if n else before, row + n

    return run


def read_ids(docs_session, path: str, with_ids: bool = True) -> DataFrame:
    """(file, row, doc_id, start_in_file, n_tokens, ids_crc32[, ids]) of every document in the files under `path`."""
    files = docs_session.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = "file string, row long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(_documents(with_ids), schema)


def file_order(name: str = "file") -> list:
    """Columns that order files as they were written: by the task's number, then by the file's number in it."""
    return [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(name, r"-c(\d+)", 1).cast("long")]


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from files written for this and read back.

    `start` counts the ids of all documents before it in ascending order of id (null first, rows of one id in order of
    text). Null and empty texts are the end id alone, very long texts are written whole; other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    path = scratch.path("files")
    write_ids(docs, path, tokenizer_path, end_id, id_col, text_col)
    found = scratch.table(read_ids(spark, path, with_ids=False), "documents")
    # one row for each file: what stands before a file in the files' order
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    before = sums.select("file", F.coalesce(F.sum("ids").over(Window.orderBy(*file_order()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return found.join(before, "file").select(F.col("doc_id").alias(id_col), (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")
