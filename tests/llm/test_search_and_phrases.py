import collections
import math
import random
import re

import pytest

from tessera.llm import collocations as co
from tessera.llm import ranked_search as rs

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_rank(docs, items, k, multiplicity=False):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * big_n // big_l if big_l else 0
            s = sum((c if multiplicity else 1) * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t, c in own.items() if t in bag)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def search(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rng = random.Random(2)
    items = [(k, " ".join(f"W{rng.randrange(400)}" for _ in range(rng.randrange(1, 30))) + " w1 w1,w1") for k in range(25)]
    items += [(50, None), (51, ""), (52, "nowhere!"), (None, "w1 w2"), (3, "x1 w7"), items[4], (53, "été ñandú kurzer")]
    return docs, items


@pytest.mark.parametrize("multiplicity", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_ranking(spark, odd_docs, search, multiplicity, small, monkeypatch):
    docs, items = search
    if small:  # many blocks of documents and items, several tiles, several chunks of a product; a bitmap that is full
        for name, value in {"BLOCK": 700, "TILE_BLOCKS": 2, "ITEM_ENTRIES": 40, "CELLS": 30, "PRODUCTS": 20, "BITMAP_BITS": 8}.items():
            monkeypatch.setattr(rs, name, value)
    table = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id int, text string, score int, term string")
    for k in (1, 7, 1000):
        got = sorted(tuple(r) for r in rs.rank_documents(odd_docs, table, k=k, multiplicity=multiplicity).collect())
        assert got == brute_rank(docs, items, k, multiplicity)


def test_ranking_of_nothing(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert rs.rank_documents(no_docs, items).count() == 0
    assert rs.rank_documents(odd_docs, items.limit(0)).count() == 0
    assert rs.rank_documents(odd_docs, spark.createDataFrame([(1, "qqq")], "item_id long, text string")).count() == 0
    names = rs.rank_documents(odd_docs, spark.createDataFrame([("one", "w1 w2")], "item_id string, text string"), k=3).collect()
    assert [(r.item_id, r["rank"]) for r in names] == [("one", 1), ("one", 2), ("one", 3)]


def test_impacts_beyond_64_bits():
    import numpy as np

    n, docs, words = 10**9, 10**12, 10**14
    m = 50 + 50 * n * docs // words
    assert rs.impacts(np.array([7]), np.array([n]), np.array([0]), docs, words).tolist() == [10**9 * 7 // (7000 + 20 * m)]


def brute_phrases(rows, longest, least, inside, top):
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = collections.defaultdict(int)
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    best[p[i : i + n]] = max(best[p[i : i + n]], a)
        kept = []
        for p, a in found.items():
            if p in best and inside[1] * best[p] >= inside[0] * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(8)
    common = ["of", "The", "new york", "a.b", "in order to", "Été", "x  y", "p\tq", "one, two", "u\nv", "wide\x0bcut", "New York city"]
    rows = [(rng.choice(["en", "de", None, ""]), " ".join(rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(300)}" for _ in range(rng.randrange(60)))) for _ in range(150)]
    return rows + [("en", None), (None, None), ("de", ""), ("fr", " . , "), ("en", "go go go " * 50), rows[0], rows[0], ("long", " ".join(rng.choice("abcdefgh") for _ in range(20_000)))]


@pytest.mark.parametrize(("longest", "least", "inside", "top"), [(3, 10, (50, 100), 2000), (2, 10, (50, 100), 5), (4, 3, (80, 100), 40), (3, 300, (1, 100), 2000)])
def test_phrases(spark, spoken, longest, least, inside, top):
    docs = spark.createDataFrame([(t, x, 1, "q") for x, t in spoken], "text string, lang string, n int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in co.collocations(docs, longest=longest, least=least, inside=inside, top=top).collect())
    assert got == brute_phrases(spoken, longest, least, inside, top) and got


def test_phrases_in_few_buckets_and_small_blocks(spark, spoken, monkeypatch):
    """Full buckets let everything through, blocks of one text and flushes after each change nothing."""
    docs = spark.createDataFrame([(t, x) for x, t in spoken], "text string, lang string")
    for bits in (14, 20):
        monkeypatch.setattr(co, "BITS", bits)
        monkeypatch.setattr(co, "BLOCK", 100)
        monkeypatch.setattr(co, "HELD", 50)
        assert sorted(tuple(r) for r in co.collocations(docs).collect()) == brute_phrases(spoken, 3, 10, (50, 100), 2000)


def test_pruning_counts_less(spark, spoken):
    """Pass 2 sends few of the word pairs that occur."""
    docs = spark.createDataFrame([(x or "und", t) for x, t in spoken], "lang string, text string").coalesce(1)
    count = lambda n, buckets, marks: docs.mapInArrow(co._count(n, 3, 10, buckets, marks), co.COUNTED).cache()
    one = count(1, None, None)
    frequent = one.filter("slice is null").groupBy("lang", "phrase").agg({"n": "sum", "key": "max"}).toDF("lang", "phrase", "f", "key").filter("f >= 10")
    pruned = count(2, co._full_buckets(one, 10), co._frequent_keys(frequent)).filter("slice is null").count()
    every = count(2, None, None).filter("slice is null").count()
    exact = count(2, None, None).filter("slice is null and n >= 10").count()
    assert exact <= pruned < 0.1 * every


def test_no_phrases(spark, no_docs):
    assert co.collocations(no_docs).count() == 0
    assert co.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        co.collocations(no_docs, longest=1)


def test_a_task_sends_phrases_before_it_holds_many():
    """Of a million distinct words the first are sent before a third is read: what a task holds does not grow with its share."""
    import pyarrow as pa

    from tessera.llm import collocations as co

    read = 0

    def batches():
        nonlocal read
        for k in range(20):
            read += 1
            words = [" ".join(f"w{k}x{i}" for i in range(a, a + 500)) for a in range(0, 50_000, 500)]
            yield pa.RecordBatch.from_arrays([pa.array(["en"] * len(words)), pa.array(words)], names=["lang", "text"])

    next(iter(co._count(1, 1, 10, None, None)(batches())))
    assert read <= 7
