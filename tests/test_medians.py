import random
import statistics

import pytest

from tessera.operators import reports
from tessera.operators.medians import medians


def table(spark, rows):
    return spark.createDataFrame(rows, "g string, v double, median int").repartition(6)


@pytest.mark.parametrize("ranges", [2, 1024])
def test_exact_medians(spark, ranges):
    """One group of nine tenths of the rows, powers that lie in one range, ties, odd and even sizes, a null group, nulls and NaN."""
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.random() * 1e6, float(rng.randrange(9))])) for _ in range(5000)]
    rows += [("powers", 10.0 ** k) for k in range(-20, 30)] + [("one", 5.5)] + [("two", -1.0), ("two", 4.0)] + [("same", 7.0)] * 40 + [(None, float(k)) for k in range(5)] + [("ends", -1e18), ("ends", 1e18), ("ends", 3.0)]
    want = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    df = table(spark, [(g, v, 1) for g, v in rows] + [("hot", None, 1), ("none", None, 1), ("same", float("nan"), 1)])
    got = {r.g: (r.median, r.low, r.high) for r in medians(df, "g", "v", ranges).collect()}
    assert got == {g: (statistics.median(v), min(v), max(v)) for g, v in want.items()}
    assert medians(df.limit(0), "g", "v").count() == 0


def test_no_group_is_gathered(spark):
    plan = medians(table(spark, [("a", 1.0, 1), ("a", 2.0, 1)]), "g", "v")._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan and "collect_list" not in plan


def test_tier_curve(spark):
    runs = spark.createDataFrame([("a", 1, 3), ("a", 2, 4), ("a", 3, 5), ("b", 4, 1), ("b", 5, 4)], "tier string, run int, score int")
    assert {tuple(r) for r in reports.tier_curve(runs).collect()} == {("a", 4, 3, 5, 2), ("b", 2, 1, 4, None)}


def test_no_slots_mean_all(spark):
    rows = spark.createDataFrame([("a", 9, "x" * 500), ("b", 0, None)], "slot string, score int, note string")
    slots = spark.createDataFrame([("a",)], "slot string")
    assert [(r.slot, r.score, len(r.note)) for r in reports.ingest_scores(rows, slots).collect()] == [("a", 5, 400)]
    assert {r.slot for r in reports.ingest_scores(rows, slots.limit(0)).collect()} == {"a", "b"}


def test_degradation(spark):
    """Lost criteria are those of the median runs; runs that did not complete, and tiers without any that did, do not count."""
    tiers = spark.createDataFrame([("full", 0), ("half", 1), ("none", 2), ("dead", 3)], "tier string, index int")
    rows = [
        ("full", 1, "completed", 90, ["a", "b", "c"]), ("full", 2, "completed", 70, ["a"]), ("full", 3, "completed", 100, ["a", "b", "c", "d"]), ("full", 4, "failed", 0, []),
        ("half", 5, "completed", 80, ["b", "d"]), ("none", 6, "completed", 20, ["b"]), ("none", 7, "completed", 10, []), ("none", 8, "completed", 40, ["c"]), ("dead", 9, "failed", 100, ["a"]),
    ]
    runs = spark.createDataFrame(rows, "tier string, run int, status string, score int, met array<string>")
    assert [tuple(r) for r in reports.degradation(tiers, runs).collect()] == [("full", "none", 70, ["a", "c"], "half")]
    assert reports.degradation(tiers, runs.filter("tier in ('full', 'dead')")).count() == 0
