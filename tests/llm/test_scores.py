import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import language_model as lm
from tessera.llm import neighbours, quality

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["</>"]


def brute_scores(rows, order):
    """The model of the docstring by dictionaries, one row after the other."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    learn = [tokens(t) for i, t in rows if not held(i)]
    grams = [collections.Counter() for _ in range(order + 1)]
    for w in learn:
        padded = ["<s>"] * (order - 1) + w
        for k in range(len(w)):
            for n in range(1, order + 1):
                grams[n][tuple(padded[k + order - n : k + order])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    count = lambda h: len(learn) if all(x == "<s>" for x in h) else grams[len(h)][h]
    words, singles = np.zeros((2, order + 1, lm.CLASSES))
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            k = int(lm.classes(np.array([count(g[:-1])]))[0])
            words[n, k] += c
            singles[n, k] += c == 1
    masses = lm.backoff_masses(words, singles)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = [math.log10((grams[1][(x,)] + 0.5) / (total + 0.5 * (types + 1))) for x in w]
        padded, score = ["<s>"] * (order - 1) + w, 0.0
        for k in range(len(w)):
            p = 10 ** base[k]
            for n in range(2, order + 1):
                g = tuple(padded[k + order - n : k + order])
                h = count(g[:-1])
                if h:
                    b = masses[n][int(lm.classes(np.array([h]))[0])]
                    p = (1 - b) * grams[n][g] / h + b * p
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(grams[1][(x,)] > 0 for x in w), total, sum(base), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, odd_docs, order, monkeypatch):
    rng = random.Random(1)
    more = [(2000 + k, " ".join(rng.choice(["the", "of", "a", "b", "cat", "dog"]) for _ in range(rng.randrange(40)))) for k in range(60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = sorted(brute_scores([tuple(r) for r in docs.collect()], order), key=repr)
    got = sorted((tuple(r) for r in lm.score_documents(docs, order=order).collect()), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def test_language_model_edges(spark, no_docs):
    assert lm.score_documents(no_docs).count() == 0
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = lm.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score for r in rows)


def test_probabilities_sum_to_one():
    """Backed-off probabilities of all words and the unknown one after a seen history."""
    words, singles = np.zeros((2, 3, lm.CLASSES))
    words[2, 3], singles[2, 3] = 30, 10
    b = lm.backoff_masses(words, singles)[2][2]
    counts = {"x": 1, "y": 1}
    lower = {"x": 0.5, "y": 0.3, "?": 0.2}
    assert abs(sum((1 - b) * counts.get(w, 0) / 2 + b * p for w, p in lower.items()) - 1) < 1e-12


def brute_neighbours(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            best = {}
            for i, y in ok:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -math.inf), float(np.add.accumulate(x * y)[-1]))
            out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return [(q, r + 1, i, -s) for q, found in out.items() for r, (s, i) in enumerate(found)]


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(120)]
    hot = rows[3][1]
    rows += [(i, hot) for i in range(200, 300)]  # one vector of many rows, ties to the smaller id
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [float("nan")] + [1.0] * 7), (404, [1.0] * 5), (405, [None] + [1.0] * 7), (None, hot), (420, [2.0] * 5), rows[7], (406, [float("inf")] * 8), (440, [1e-30] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2, "s") for i, v in rows], "vec_id long, embedding array<float>, label int, h int, ids string")
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 50)
    got = [tuple(r) for r in neighbours.nearest(df, "vec_id % 20 = 0", k=20).collect()]
    want = brute_neighbours([(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows], 20)
    assert sorted(got) == sorted(want)
    assert neighbours.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert neighbours.nearest(df, "false").count() == 0


def test_quantisation_bound():
    x, y = np.random.default_rng(1).normal(size=(2, 50, 64))
    (p, s, n, d), (q, t, m, e) = quality_free(x), quality_free(y)
    rough = (p.astype(int) * q.astype(int)).sum(axis=1) * s * t
    assert (np.abs(rough - (x * y).sum(axis=1)) <= d * np.linalg.norm(y, axis=1) + n * e + 1e-9).all()


quality_free = neighbours.quantise


def noisy(rng, n):
    return "\n".join(" ".join(rng.choice("abcdefgh") + "%%%" for _ in range(10)) for _ in range(n))


def clean(rng, n):
    return "\n".join(" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "ran"]) + rng.choice("xyz") for _ in range(10)) + "." for _ in range(n))


def test_quality_held_out(spark, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, noisy(rng, rng.randrange(1, 6)) if i % 4 == 0 else clean(rng, rng.randrange(1, 6))) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels, sample=150)
    got = quality.score_quality(docs, field).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert quality.keep_good(docs, field).columns == docs.columns
    odd = quality.score_quality(odd_docs, field).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score_quality(no_docs, field).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in quality.score_quality(docs, nothing).collect()} == {0.5}


def test_quality_reads_whole_documents(spark, monkeypatch):
    """A document of 300 lines is trained on by all of them, in the field and in its evidence."""
    rows = [(k, "\n".join(f"line {i} of {k}." for i in range(300 if k == 1 else 3))) for k in range(1, 12)]
    held_out = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, weight, first, labels: seen.append((len(x), len(weight), np.diff(first).tolist())) or quality.Field(np.zeros(1), np.zeros((2, 2))))
    quality._fitted(quality.training_lines(docs, labels).toArrow())
    want = [300 if k == 1 else 3 for k, _ in rows if k not in held_out]
    assert 300 in want and seen == [(sum(want), sum(want), want)]


def test_forward_backward_against_all_labellings():
    import itertools

    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    x, first = rng.normal(size=(9, 4)), np.array([0, 4, 5, 9])
    good, joint, z, _ = field.marginals(x, first)
    want, total, pairs = np.zeros(9), 0.0, np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        each = {y: sum((x[a + i] @ field.weights) * y[i] for i in range(b - a)) + sum(field.steps[y[i], y[i + 1]] for i in range(b - a - 1)) for y in itertools.product((0, 1), repeat=b - a)}
        norm = np.logaddexp.reduce(list(each.values()))
        total += norm
        for y, s in each.items():
            want[a:b] += np.exp(s - norm) * np.array(y)
            for i in range(b - a - 1):
                pairs[y[i], y[i + 1]] += np.exp(s - norm)
    assert np.allclose(good, want) and np.allclose(joint, pairs) and abs(z - total) < 1e-9
