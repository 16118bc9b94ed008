"""Whole tables against brute force, where the SQL is over a part or too slow."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.operators import graph
from tessera.operators import vectors as vec
from tessera.plans import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs():
    """(a, b, label of a, label of b, product) of all pairs of the table."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x = np.array(t["embedding"], dtype=np.float64)
    sim = np.zeros((len(x), len(x)))
    for c in range(x.shape[1]):
        sim += np.multiply.outer(x[:, c], x[:, c])
    order = np.argsort(t["vec_id"])
    ids, labels = np.array(t["vec_id"])[order].tolist(), np.array(t["label"])[order].tolist()
    sim = sim[np.ix_(order, order)]
    return [(ids[i], ids[j], labels[i], labels[j], float(sim[i, j])) for i in range(len(ids)) for j in range(i + 1, len(ids))]


@pytest.fixture(params=[1024, 90])
def block(request, monkeypatch):
    inner = vec.tiled
    monkeypatch.setattr(vec, "tiled", lambda *a, **k: inner(*a, **k, block=request.param))


def clusters(pairs):
    up = {i: i for p in pairs for i in p[:2]}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b, *_, s in pairs:
        if s >= 0.6:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def test_embeddings_are_searched_whole(spark, block, pairs):
    rows = {q: [tuple(r) for r in QUERIES[q](spark, SF).collect()] for q in ("separation_metrics", "nearest_other_label", "threshold_clusters", "boundary_view", "cosine_topk")}
    same, other = [p[4] for p in pairs if p[2] == p[3]], [p[4] for p in pairs if p[2] != p[3]]
    want = [min(same), max(other), sum(same) / len(same), sum(other) / len(other), min(same) - max(other), (min(same) + max(other)) / 2]
    assert np.allclose(rows["separation_metrics"][0], want, atol=2e-6, rtol=0)
    assert max(p[1] for p in pairs) >= 200

    both = [*pairs, *((b, a, gb, ga, s) for a, b, ga, gb, s in pairs)]
    best, ranked = {}, {}
    for a, b, ga, gb, s in both:
        if ga != gb:
            best[a, ga] = min(best.get((a, ga), (9e9, 0)), (-np.round(s, 9), b))
        if a % 20 == 0:
            ranked.setdefault(a, []).append((-np.round(s, 9), b))
    assert {(a, g): b for a, g, b in rows["nearest_other_label"]} == {k: b for k, (_, b) in best.items()}
    assert sorted(rows["cosine_topk"]) == sorted((q, v, r + 1) for q, found in ranked.items() for r, (_, v) in enumerate(sorted(found)[:5]))
    assert dict(rows["threshold_clusters"]) == clusters(pairs)

    keyed = [(float(np.round(s, 9)), a, b) for a, b, *_, s in pairs]
    down = lambda p: (-p[0], *p[1:])
    view = {*sorted(keyed, key=down)[:3], *sorted(p for p in keyed if p[0] >= 0.6)[:3], *sorted((p for p in keyed if p[0] < 0.6), key=down)[:4]}
    assert {(a, b) for a, b, _ in rows["boundary_view"]} == {(a, b) for _, a, b in view} and len(rows["boundary_view"]) == len(view)


def test_tiles_take_odd_rows(spark):
    """Null labels, vectors of other lengths or none, an id that repeats."""
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.5, 0.5]), (2, 2, [1.0, 1.0]), (3, None, [1.0, 0.0]), (4, 2, [1.0]), (5, 2, None)], "vec_id long, label int, embedding array<double>")
    for size in (1, 1000):
        s = vec.separation(rows, block=size).first()
        assert (s.low_same, s.high_other) == (0.0, 1.0)
        assert {(r.q, r.b) for r in vec.nearest(rows, 1, block=size).collect()} == {(1, 2), (2, 1), (3, 1), (4, 1), (5, 1)}
        assert vec.links(rows, 2.0, block=size).count() == 0


def test_popular_items_couple_their_holders(spark, tmp_path):
    """Items of 51 and more holders, one that all hold, one of a single holder; by tiles and in one."""
    rows = [(h, "all") for h in range(80)] + [(h, "many") for h in range(60)] + [(h, "some") for h in range(51)] + [(7, "own"), (3, "few"), (70, "few"), (3, "few")]
    held = defaultdict(set)
    for h, item in rows:
        held[item].add(h)
    want = Counter()
    for holders in held.values():
        for pair in combinations(sorted(holders), 2):
            want[pair] += math.log(80 / len(holders))
    members = spark.createDataFrame(rows, "holder long, item string")
    for size in (256, 20):
        got = {(r.a, r.b): r.weight for r in graph.co_membership(members, holders=size).collect()}
        assert set(got) == set(want) and all(abs(got[k] - w) < 1e-9 for k, w in want.items())
    spark.createDataFrame([(h, 1) for h in range(60)] + [(60, 2), (61, 2)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = QUERIES["coinclusion_edges"](spark, str(tmp_path)).collect()
    assert len(edges) == 60 * 59 // 2 + 1 and {r.weight for r in edges} == {round(math.log(62 / 60), 6), round(math.log(31), 6)}


def test_the_sweep_is_whole(spark):
    runs = QUERIES["community_sweep"](spark, SF).collect()
    assert {(r.resolution, r.seed) for r in runs} == {(g, s) for g in (0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0) for s in range(1, 13)} and len(runs) == 84
