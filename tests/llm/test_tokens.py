import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.idfile import BITS, BYTES, decode_segment, encode_segment, file_order, round_trip
from tessera.llm.packing import cost, pack, pack_documents
from tessera.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module", params=FILES)
def both(request):
    path = public_tokenizers.path(request.param)
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        return library, Encoder(f.read())


def library_ids(file, texts):
    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ids_of(encoder, texts):
    out = []
    for _, ids, counts in encoder.encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r 　 ab'sÉ́Σς1!|<>endoftext"), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=5))
def test_same_as_library(both, texts):
    library, encoder = both
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


SPECIAL = ["hello <|endoftext|> world", "<|endoftext|>", "a\n<|endoftext|>\nb  c", " <|startoftext|>x<|endoftext|> ", "<|endoftext", "|>plain", "two <|EndOfText|> cases", "x <|endoftext|><|endoftext|> y", ""]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "endoftext|>", " ", "  ", "\n", "word", "é", "\u3000", "'s"]), max_size=12).map("".join), min_size=1, max_size=6))
def test_special_strings_as_in_the_untouched_library(both, texts):
    library, encoder = both
    for some in (texts, SPECIAL):
        assert ids_of(encoder, some) == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_special_strings_as_text():
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        assert ids_of(Encoder(f.read(), special_as_text=True), SPECIAL) == [e.ids for e in library.encode_batch(SPECIAL, add_special_tokens=False)]


def test_files_in_order_of_number(spark):
    names = ["part-100000-u-c000.txt", "part-99999-u-c001.txt", "part-99999-u-c000.txt", "part-00002-u-c010.txt", "part-00002-u-c9.txt"]
    got = [r.file for r in spark.createDataFrame([(n,) for n in names], "file string").orderBy(*file_order()).collect()]
    assert got == ["part-00002-u-c9.txt", "part-00002-u-c010.txt", "part-99999-u-c000.txt", "part-99999-u-c001.txt", "part-100000-u-c000.txt"]


def test_pack_takes_the_cheapest_sequence_with_room():
    """The rule by plain lists: descending documents, each to the lowest cost that has room, else cut over the lowest costs."""
    rng = np.random.default_rng(9)
    for capacity in (16, 100):
        lengths = rng.integers(1, 2 * capacity, 150)
        pieces, costs = pack(lengths, capacity)
        n_full = sum(n // capacity for n in lengths.tolist())
        rests = sorted(((n % capacity, d) for d, n in enumerate(lengths.tolist()) if n % capacity), key=lambda r: (-r[0], r[1]))
        filled = [0] * -(-sum(n for n, _ in rests) // capacity)
        paid, want = [0.0] * len(filled), []
        for n, d in rests:
            start = int(lengths[d]) // capacity * capacity
            room = [s for s in range(len(filled)) if filled[s] + n <= capacity]
            while n:
                s = min(room or [s for s in range(len(filled)) if filled[s] < capacity], key=lambda s: paid[s])
                part = min(n, capacity - filled[s])
                want.append((d, start, part, n_full + s, filled[s]))
                filled[s], paid[s], start, n = filled[s] + part, paid[s] + cost(part), start + part, n - part
        assert sorted(p for p in pieces if p[3] >= n_full) == sorted(want) and np.allclose(costs[n_full:], paid)


def test_pack_properties():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 3000, 400)
    pieces, costs = pack(lengths, 1024)
    filled = np.zeros(len(costs), np.int64)
    covered = np.zeros(len(lengths), np.int64)
    paid = np.zeros(len(costs))
    for d, start, n, s, offset in pieces:
        assert offset == filled[s] and n > 0
        filled[s] += n
        paid[s] += cost(n)
        covered[d] += n
    assert (covered == lengths).all() and filled.max() <= 1024 and np.allclose(paid, costs)
    assert 1024 * len(costs) - lengths.sum() < 1024
    for d in range(len(lengths)):
        own = sorted((start, n) for e, start, n, _, _ in pieces if e == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_pack_documents(odd_docs, no_docs):
    path = public_tokenizers.path(FILES[0])
    rows = odd_docs.collect()
    want = sorted(zlib.crc32(np.array(i + [0], "<u4").tobytes()) for i in library_ids(FILES[0], [r.text or "" for r in rows]))
    got = pack_documents(odd_docs.coalesce(1), path).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 1024
    pieces = got.sort_values(["sequence_id", "offset"])
    assert all((g.offset.to_numpy() == np.cumsum(g.length.to_numpy()) - g.length.to_numpy()).all() for _, g in pieces.groupby("sequence_id"))
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(got.ids, got.ids_crc32))
    ids = got.sort_values(["doc_id", "start"])
    single = ids[ids.doc_id.notna()].groupby("doc_id").filter(lambda g: (g.start == 0).sum() == 1)
    rebuilt = single.groupby("doc_id").ids.apply(lambda parts: zlib.crc32(np.concatenate([np.array(p) for p in parts]).astype("<u4").tobytes()))
    assert set(rebuilt) <= set(want)
    assert got.length.sum() == sum(len(i) + 1 for i in library_ids(FILES[0], [r.text or "" for r in rows]))
    assert pack_documents(no_docs, path).count() == 0


@pytest.mark.parametrize("kind", [BITS, BYTES])
def test_segment_round_trip(kind):
    rng = np.random.default_rng(0)
    counts = np.array([0, 5, 70_000, 1])
    ids = rng.integers(0, 60_000, counts.sum()).astype(np.uint32)
    data = encode_segment([None, 3, -4, 9], counts, ids, block=4096, kind=kind)
    keys, sizes, back, length = decode_segment(memoryview(data + b"\nrest"))
    assert keys == [None, 3, -4, 9] and (sizes == counts).all() and (back == ids).all() and length == len(data)


def test_files_round_trip(odd_docs, no_docs):
    path = public_tokenizers.path(FILES[1])
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in odd_docs.collect()))
    want, at = [], 0
    for (has, i, _, _), ids in zip(rows, library_ids(FILES[1], [t for *_, t in rows])):
        want.append((i if has else None, at, len(ids) + 1, zlib.crc32(np.array(ids + [2], "<u4").tobytes())))
        at += len(ids) + 1
    got = [tuple(r) for r in round_trip(odd_docs, path, 2).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert round_trip(no_docs, path, 2).count() == 0
