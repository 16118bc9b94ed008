import random
import re

import numpy as np
import pytest

from tessera.llm.near_dedup import LANES, equal_lanes_needed, estimate, keep_one, minima, near_duplicates, pack
from tessera.llm.shared import Scratch, components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, num, den):
    """component of each row's id, by all pairs."""
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            both = len(s & t)
            if s and t and both * den >= num * (len(s) + len(t) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up}


@pytest.mark.parametrize("num,den", [(85, 100), (4, 5)])
def test_against_brute_force(odd_docs, num, den):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(rows, num, den)
    got = near_duplicates(odd_docs, least=(num, den), bands=32, rows=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = sorted((str(r.doc_id), r.n_shingles) for r in got)
    assert sizes == sorted((str(i), len(shingles(t))) for i, t in rows)


def test_large_bucket_is_whole(spark):
    """A hot family of near copies: tiles, partner rounds and the rest give brute force's components."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 85, 100)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, least=(85, 100)).collect()} == want


def test_ids_that_repeat_without_words(spark):
    """Members of a bucket whose ids also have null, empty and blank rows: no link is lost, by pairs and by tiles."""
    rng = random.Random(6)
    for copies in (12, 80):
        base = [f"w{i}" for i in range(120)]
        rows = []
        for k in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1, 8)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((k, " ".join(w)))
            if k % 2:
                rows.append((k, (None, "", " \n")[k % 3]))
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        want = brute(rows, 85, 100)
        got = near_duplicates(docs, least=(85, 100)).collect()
        assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == want


def test_long_signer_passes_over_rows_without_words():
    import pyarrow as pa

    from tessera.llm.near_dedup import long_signer

    full = ["a b c d e f g", "h i j k l m n o"]
    sign = lambda ids, texts: [r for b in long_signer(5)(iter([pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])])) for r in b.to_pylist()]
    want = sign([1, 2], full)
    assert [len(r["signature"]) for r in want] == [48, 48]
    assert sign([1, 1, 2, 2], [full[0], None, full[1], " "]) == want and sign([2, 1, 2], ["", *full]) == want
    assert sign([1], [None]) == []


def test_empty_and_keep_one(odd_docs, no_docs):
    assert near_duplicates(no_docs).count() == 0 and keep_one(no_docs).count() == 0
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()], 4, 5)
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in want.items() if i == c}) and ids.count(None) == 2


def test_estimate_tracks_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for keep in (1.0, 0.9, 0.5):
        b = np.concatenate([a[: int(2000 * keep)], rng.integers(0, 1 << 63, 2000 - int(2000 * keep)).astype(np.uint64)])
        sa, sb = (pack(minima(x, np.array([0, len(x)]))) for x in (a, b))
        x = (sa ^ sb)[0]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = LANES - int(np.bitwise_count(x & np.uint64(0x1111111111111111)).sum())
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(estimate(equal) - true) < 0.15
    assert equal_lanes_needed(0.85) < LANES * 0.86


def test_components_in_rounds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    by_task, by_rounds = ({r.id: r.label for r in components(df, Scratch(spark, "t"), n).collect()} for n in (10**6, 0))
    assert by_task == by_rounds and by_task[440] == 400
