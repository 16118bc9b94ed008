import numpy as np

from tessera.operators import vectors as vec


def brute(x, y, penalty):
    """Each row by a regression that is fitted anew on all others."""
    out, names = [], sorted(set(y))
    whole = x - x.mean(axis=0)
    ridge = penalty * np.trace(whole.T @ whole) / x.shape[1] * np.eye(x.shape[1])
    for i in range(len(x)):
        keep = np.arange(len(x)) != i
        a, b = x[keep], np.array(y, object)[keep]
        mean = a.mean(axis=0)
        target = np.stack([(b == c).astype(float) for c in names], axis=1)
        w = np.linalg.solve((a - mean).T @ (a - mean) + ridge, (a - mean).T @ (target - target.mean(axis=0)))
        score = target.mean(axis=0) + (x[i] - mean) @ w
        score[target.sum(axis=0) == 0] = -np.inf
        out.append(names[int(np.round(score, 12).argmax())])
    return out


def test_as_by_fits_without_each_row(spark):
    """Overlapping classes, one of a single row, so that many predictions hang on the row's absence; odd rows take no part."""
    rng = np.random.default_rng(2)
    y = [f"c{k}" for k in rng.integers(0, 5, 180)] + ["alone"]
    x = rng.normal(size=(181, 7)) + np.array([int(c[1]) if c != "alone" else 9 for c in y])[:, None] * rng.normal(size=7) * 0.5
    odd = [(900, "c1", None), (901, None, [1.0] * 7), (None, "c1", [1.0] * 7), (902, "c1", [1.0]), (903, "c1", [float("nan")] * 7)]
    rows = [(i, c, [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))] + odd
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(5)
    got = vec.supervised_leave_one_out(df, penalty=1e-2)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.vec_id: r.predicted for r in got.collect()}
    want = brute(x, y, 1e-2)
    assert got == dict(enumerate(want)) and 0.3 < np.mean([a == b for a, b in zip(want, y)]) < 0.97


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0])], "vec_id long, label string, embedding array<double>")
    assert [tuple(r) for r in vec.supervised_leave_one_out(df).collect()] == [(1, "a", None)]
    assert vec.supervised_leave_one_out(df.limit(0)).count() == 0
