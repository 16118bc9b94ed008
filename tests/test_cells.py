"""Exact searches by cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as vec
from tessera.sources.shared import stored


def clustered(rng, n, centres=12, width=16):
    middle = rng.normal(size=(centres, width))
    x = middle[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x):
    return spark.createDataFrame([(i, int(i % 3), [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>").repartition(4)


def parts(pairs, n):
    label = list(range(n))

    def top(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in pairs:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(a) for a in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "spread", "scaled", "copies"])
def test_as_all_pairs(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    x = clustered(rng, 300)
    if kind == "spread":
        x = rng.normal(size=(200, 6))
    elif kind == "scaled":
        x = x * rng.choice([0.1, 1.0, 7.0], size=(300, 1))
    elif kind == "copies":
        x = np.concatenate([x[:50], np.repeat(x[:1], 150, axis=0)])
    monkeypatch.setattr(vec, "BLOCK", 40)
    df, n = table(spark, x), len(x)
    sim = np.add.accumulate(x[:, None, :] * x[None], axis=2)[:, :, -1]
    for least in (0.6, -0.5):
        want = parts([(a, b) for a in range(n) for b in range(a + 1, n) if sim[a, b] >= least], n)
        assert parts([(r.a, r.b) for r in vec.linked(df, least).collect()], n) == want
    for k in (1, 4):
        near = np.round(sim, 9)
        want = {(a, b) for a in range(n) for b in sorted((b for b in range(n) if b != a), key=lambda b: (-near[a, b], b))[:k]}  # noqa: B023
        assert {(r.q, r.b) for r in vec.nearest_by_cells(df, k).collect()} == want


def test_few_pairs_meet(spark, monkeypatch):
    """On clustered rows under a fifth of all pairs are compared, for links and for neighbours."""
    monkeypatch.setattr(vec, "BLOCK", 64)
    x = clustered(np.random.default_rng(5), 1500, centres=40, width=24)
    cells, schema = vec.Cells(table(spark, x)), "n long"
    import pyarrow as pa

    compared = lambda t: pa.table({"n": [int(t.pair.sum())]})
    count = lambda **of: sum(r.n for r in cells.tiles(compared, schema, **of).collect())
    from pyspark.sql import functions as F

    every = 1500 * 1499 / 2
    assert count(visitors=cells.visitors(cells.rows.withColumn("least", F.lit(0.8)), later=True)) < 0.2 * every
    best = cells.rows.withColumn("least", F.lit(0.9))
    assert count() + count(visitors=cells.visitors(best, later=False), inner=False) < 0.2 * every


def test_rows_that_cannot_be_dealt(spark):
    """Vectors of two lengths, null or not finite: the way of all tiles takes over, with the same rows as before."""
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [1.0]), (4, 1, None), (None, 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert not vec.Cells(df).sound and [(r.a, r.b) for r in vec.linked(df, 0.6).collect()] == [(1, 2)]
    assert vec.linked(df.limit(0), 0.6).count() == 0 and vec.nearest_by_cells(df.limit(0), 1).count() == 0


def test_askers_against_all(spark, monkeypatch):
    monkeypatch.setattr(vec, "BLOCK", 30)
    x = clustered(np.random.default_rng(8), 120)
    sim = np.round(np.add.accumulate(x[:, None, :] * x[None], axis=2)[:, :, -1], 9)
    got = {(r.q, r.b, r.r) for r in vec.nearest(table(spark, x), 3, "vec_id % 20 = 0").collect()}
    assert got == {(a, b, k + 1) for a in range(0, 120, 20) for k, b in enumerate(sorted((b for b in range(120) if b != a), key=lambda b: (-sim[a, b], b))[:3])}  # noqa: B023


def test_splits_without_rows(spark, monkeypatch):
    """Files read in splits that hold no row group: the pairs to come are counted as doubles there too."""
    df = table(spark, clustered(np.random.default_rng(9), 400, centres=60))
    rows = stored(df.coalesce(1))
    for key, value in (("spark.sql.files.maxPartitionBytes", "4k"), ("spark.sql.files.openCostInBytes", "0")):
        spark.conf.set(key, value)
    try:
        monkeypatch.setattr(vec, "GAIN", 1)
        cells = vec.Cells(rows)
        assert 0 in cells.rows.rdd.glom().map(len).collect() and cells.pays(cells.rows.withColumn("least", F.lit(0.9)), later=True)
    finally:
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(key)
