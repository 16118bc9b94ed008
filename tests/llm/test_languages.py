import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id as li

ENDS = {"aa": "a", "bb": "o", "cc": "u"}


def prose(rng, lang, n):
    """Invented words whose vowels tell the language."""
    return " ".join("".join(rng.choice("bcdfgt") + ENDS[lang] for _ in range(rng.randrange(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, prose(rng, lang := rng.choice(list(ENDS)), rng.randrange(2, 60)), lang) for i in range(400)]


@pytest.fixture(scope="module")
def model(spark, rows):
    return li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute_counts(texts):
    """n-gram counts of the docstring by a dictionary, keyed by bytes; a word begins with one space and ends with one."""
    out = {}
    for t in texts:
        for word in re.findall(r"[^\W\d_]+", (t or "").lower()):
            padded = b" " + word.encode() + b" "
            for i in range(len(padded)):
                for n in range(1, li.ORDER + 1):
                    if i - n + 1 >= 0:
                        g = padded[i - n + 1 : i + 1]
                        out[g] = out.get(g, 0) + 1
            out[b""] = out.get(b"", 0) + len(padded) - 1
    return out


def brute_likelihood(counts, word):
    padded, total = b" " + word.encode() + b" ", 0.0
    for i in range(1, len(padded)):
        p = 1 / 256
        for n in range(1, li.ORDER + 1):
            if i - n + 1 >= 0:
                g = padded[i - n + 1 : i + 1]
                seen, history = counts.get(g, 0), counts.get(g[:-1], 0)
                p = (seen + li.BACKOFF * p) / (max(history, seen) + li.BACKOFF)
        total += math.log(p)
    return total


def test_word_likelihoods_against_dictionaries(rows, monkeypatch):
    """Slots are hashed; with so many none collide here, so tables and dictionaries agree."""
    monkeypatch.setattr(li, "SLOTS", 1 << 23)
    rows = rows[:30]
    by = {lang: [t for _, t, x in rows if x == lang] for lang in ENDS}
    model = li.Model(list(ENDS), np.stack([li.count_grams(pa.array(t)) for t in by.values()], axis=1).astype(np.float32), np.full(3, 1 / 3))
    counts = [brute_counts(t) for t in by.values()]
    words = ["bacada", "toto", "x", "gucu", "été"]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    units = li.Units(raw, np.array([0, len(raw)]))
    spelled = [raw[a:b].tobytes().decode() for a, b in zip(units.starts, units.ends)]
    assert sorted(spelled) == sorted(words)
    assert np.allclose(model.word_likelihoods(units), [[brute_likelihood(c, w) for c in counts] for w in spelled], rtol=1e-5)


def test_expectation_maximisation_reaches_the_best_proportions():
    rng = np.random.default_rng(0)
    like, weight = rng.random((40, 2)) + 0.01, rng.integers(1, 4, 40).astype(float)
    theta, value = li._climb(like, weight, np.array([0, 40]), np.ones((1, 2), bool), rounds=5000, least=1e-10)
    grid = np.linspace(0, 1, 10_001)
    each = [(weight * np.log(p * like[:, 0] + (1 - p) * like[:, 1])).sum() for p in grid]
    assert abs(grid[int(np.argmax(each))] - theta[0, 0]) < 2e-3 and value[0] >= max(each) - 1e-6


def test_held_out_accuracy_and_mixtures(spark, rows, model):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t, _ in rows], "doc_id long, text string, score int, lang_pred string")
    got = {r.doc_id: r for r in li.identify(docs, model).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 40 and all(a == b for a, b in held)
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions) - 1) < 1e-6 for r in got.values())
    rng = random.Random(9)
    mixed = [(1, prose(rng, "aa", 60) + ". " + prose(rng, "bb", 40)), (2, prose(rng, "cc", 100)), (3, prose(rng, "aa", 50) + prose(rng, "bb", 30) + " " + prose(rng, "cc", 20))]
    one, two, three = (r for r in li.identify(spark.createDataFrame(mixed, "doc_id long, text string"), model).orderBy("doc_id").collect())
    assert one.languages == ["aa", "bb"] and np.allclose(one.proportions, [0.6, 0.4], atol=0.05) and one.lang_pred == "aa"
    assert two.languages == ["cc"] and two.proportions == [1.0]
    assert three.languages == ["aa", "bb", "cc"]


def test_odd_texts(spark, odd_docs, no_docs, model):
    got = li.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 and r.languages == [] for r in got if r.doc_id in (500, 501, 502))
    assert all(r.held_out is None for r in got if r.doc_id is None)
    assert li.identify(no_docs, model).count() == 0
    texts = [(1, "123 -- !"), (2, "1 a 2"), (3, "́"), (4, "漢字" * 200), (5, "aÁAa")]
    rows = {r.doc_id: r for r in li.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    assert [rows[i].lang_pred == "und" for i in range(1, 6)] == [True, False, True, False, False]


def test_nothing_to_learn(spark, odd_docs, no_docs):
    for docs in (no_docs, odd_docs.withColumn("lang", odd_docs.lang.substr(5, 1).try_cast("int").cast("string"))):
        nothing = li.train(docs.filter("lang is null") if docs is not no_docs else docs)
        assert nothing.names == [] and {r.lang_pred for r in li.identify(odd_docs, nothing).collect()} == {"und"}
    held = spark.createDataFrame([(i, "a b", "xx") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0] + [(None, "c d", "yy")], "doc_id long, text string, lang string")
    assert li.train(held).names == []


def test_only_the_largest_languages(spark, rows):
    more = rows + [(1000 + i, "zizi", f"l{i}") for i in range(30)]
    few = li.train(spark.createDataFrame(more, "doc_id long, text string, lang string"), languages=3)
    assert few.names == sorted(ENDS)
    assert few.counts.shape == (li.SLOTS, 3)
