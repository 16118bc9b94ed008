"""Metrics as grouped aggregates: counters, gauges, cumulative histograms, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Upper bounds of the buckets in milliseconds.
BOUNDS = (0.5, 1, 2, 5, 10, 25, 50, 100, 250, 500, 1000)


def histogram(rows: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, le, cumulative, total, n): one pass with a conditional count for each bound, then a row for each bound."""
    counted = rows.groupBy(*groups).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.sum(value).alias("total"), F.count(value).alias("n"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(BOUNDS)))
    return counted.select(*groups, F.inline(cells), "total", "n")


def next_leased(tasks: DataFrame, now, seconds: int = 30) -> DataFrame:
    """The oldest task that is queued or whose lease has run out: at most one row."""
    open_ = (F.col("status") == "queued") | ((F.col("status") == "claimed") & (F.col("claimed_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {seconds} seconds")))
    return tasks.filter(open_).orderBy("created_at", "id").limit(1)
