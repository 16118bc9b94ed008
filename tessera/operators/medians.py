"""Exact medians of groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import small

#: Ranges that a group's values are counted by at once.
RANGES = 1024


def medians(rows: DataFrame, group: str, value: str, ranges: int = RANGES) -> DataFrame:
    """(group, median, low, high): the mean of the two middle values of each group, which are one where there is an odd number of them, and its ends.

    Equal values are added up first, by group and value, so that a hot group is dealt over all tasks. The values of a group
    are then counted by `ranges` ranges of equal width, and only the range that holds a middle rank is cut again, until
    it is one value: no task sees more than the ranges of a group. Nulls and NaN are ignored, a group without values has
    no row; values are to be finite.
    """
    v = F.col(value).cast("double")
    each = stored(rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(group).alias("g"), v.alias("v")).agg(F.count("*").alias("n")))
    whole = stored(each.groupBy("g").agg(F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")))
    sought = whole.select(F.col("g").alias("of"), F.posexplode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("k", "rank"), "low", "high")
    found = []
    while True:
        near = each.join(small(sought), F.col("g").eqNullSafe(F.col("of")) & F.col("v").between(F.col("low"), F.col("high")))
        width = F.col("high") - F.col("low")
        slot = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width * ranges), F.lit(ranges - 1))).otherwise(0)
        counted = near.groupBy("of", "k", "rank", slot.alias("slot")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("of", "k").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counted.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        hit = stored(hit.select("of", "k", (F.col("rank") - F.col("before")).alias("rank"), "low", "high"))
        found.append(hit.filter("low = high").select(F.col("of").alias(group), F.col("low").alias("middle")))
        sought = hit.filter("low < high")
        if sought.isEmpty():
            middle = reduce(DataFrame.unionAll, found).groupBy(F.col(group).alias("of")).agg(F.avg("middle").alias("median"))
            return whole.join(middle, F.col("g").eqNullSafe(F.col("of"))).select(F.col("g").alias(group), "median", "low", "high")
