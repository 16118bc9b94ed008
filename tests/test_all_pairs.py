"""Matrix products in blocks and patches against all pairs summed one by one."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import all_pairs as ap
from tessera.operators import vectors as vec


def rows_of(kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(130, 8))
    if kind == "unit":
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    elif kind == "copies":  # ties everywhere
        x = np.round(x[rng.integers(0, 9, 130)], 1)
    elif kind == "large":
        x = x * 1e4
    label = [None if i % 11 == 0 else int(i % 4) for i in range(130)]
    ids = rng.permutation(130).tolist()
    return [(i, g, v.tolist()) for i, g, v in zip(ids, label, x)]


@pytest.mark.parametrize("kind", ["unit", "copies", "large"])
@pytest.mark.parametrize("block,step", [(1000, 512), (1000, 7), (40, 16)])
def test_as_one_by_one(spark, kind, block, step, monkeypatch):
    monkeypatch.setattr(ap, "STEP", step)
    monkeypatch.setattr(ap, "PIECE_BYTES", 16 * step)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    rows.sort()
    n, x, g = len(rows), np.array([r[2] for r in rows]), [r[1] for r in rows]
    sim = np.add.accumulate(x[:, None, :] * x[None], axis=2)[:, :, -1]
    near, pairs = np.round(sim, 9), [(a, b) for a in range(n) for b in range(a + 1, n)]
    # tasks may read the module's own step, so work is done here too
    run = lambda work: work(ap.Pair(ap.packed(np.float64)(block_of(rows)), np.float64))
    for k in (1, 3):
        for other in (False, True):
            may = lambda a, b: a != b and (not other or (g[a] is not None and g[b] is not None and g[a] != g[b]))  # noqa: B023, E731
            want = {(a, b) for a in range(n) for b in sorted((b for b in range(n) if may(a, b)), key=lambda b: (-near[a, b], b))[:k]}  # noqa: B023
            assert {(r.q, r.b) for r in vec.nearest(df, k, other_group=other, block=block).collect()} == want
            t = run(ap.best_work(k, other))
            assert set(zip(t.column("q").to_pylist(), t.column("b").to_pylist())) == want
    known = [(a, b) for a, b in pairs if g[a] is not None and g[b] is not None]
    same, other = ([sim[p] for p in known if (g[p[0]] == g[p[1]]) is s] for s in (True, False))
    s = vec.separation(df, block=block).first()
    assert (s.low_same, s.high_other) == (min(same), max(other)) and np.allclose([s.mean_same, s.mean_other], [np.mean(same), np.mean(other)], rtol=1e-9)
    for least in (float(np.quantile(sim, 0.97)), float(sim[3, 5])):
        top = list(range(n))
        for a, b in pairs:
            if sim[a, b] >= least:
                u, v = top[a], top[b]
                top = [min(u, v) if t in (u, v) else t for t in top]
        found = list(range(n))
        for r in vec.links(df, least, block=block).collect():
            u, v = found[r.a], found[r.b]
            found = [min(u, v) if t in (u, v) else t for t in found]
        assert found == top
        by = lambda some, sign: sorted(some, key=lambda p: (sign * near[p], p))
        want = {*by(pairs, -1)[:3], *by([p for p in pairs if sim[p] >= least], 1)[:3], *by([p for p in pairs if sim[p] < least], -1)[:4]}
        assert {(r.a, r.b) for r in vec.boundary(df, least, block=block).collect()} == want
        t = run(ap.boundary_work(least, 3, 3, 4))
        assert set(zip(t.column("a").to_pylist(), t.column("b").to_pylist())) == want


def block_of(rows):
    return pa.table({"block": pa.array([0] * len(rows), pa.int32()), "id": pa.array([r[0] for r in rows], pa.int64()), "label": pa.array([None if r[1] is None else str(r[1]) for r in rows], pa.string()), "vector": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})


def test_copies_of_a_row_do_not_grow_with_the_table(spark, monkeypatch):
    """Blocks grow with the table, so a row is sent to as many others however many rows there are."""
    sent = []
    for n in (4, 8):
        df = spark.createDataFrame([(i, i % 3, [1.0, float(i)]) for i in range(24 * n)], "vec_id long, label int, embedding array<double>")
        monkeypatch.setattr(ap, "LEAST_ROWS", 2)
        met = ap.all_pairs(df, lambda t: pa.table({"n": [len(t.x) + (0 if t.square else len(t.y))]}), "n long").groupBy().sum("n").first()[0]
        sent.append(met / (24 * n))
    assert sent[0] == pytest.approx(sent[1], rel=0.2) and sent[1] < 30


def test_what_rounds_to_the_threshold_is_below_it(spark):
    """A product that falls short of the threshold by less than 1e-9 is below it, as in SQL."""
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.6 - 1e-10, 0.0]), (3, 1, [0.7, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {(r.a, r.b) for r in vec.boundary(df, 0.6, 1, 1, 1).collect()} == {(1, 3), (1, 2)}


@pytest.mark.parametrize("gain", [0, 10**9])
def test_both_ways_agree(spark, gain, monkeypatch):
    """By cells and by all pairs: the same links and the same neighbours."""
    monkeypatch.setattr(vec, "GAIN", gain)
    rows = sorted(rows_of("unit"))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    x = np.array([r[2] for r in rows])
    near = np.round(np.add.accumulate(x[:, None, :] * x[None], axis=2)[:, :, -1], 9)
    assert {(r.q, r.b) for r in vec.nearest_by_cells(df, 2).collect()} == {(a, b) for a in range(130) for b in sorted((b for b in range(130) if b != a), key=lambda b: (-near[a, b], b))[:2]}
    cells = vec.Cells(df)
    assert cells.pays(cells.rows.selectExpr("*", "0.9D AS least"), True) is (gain == 0)
