"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int) -> Column:
    """A double rounded half up in binary arithmetic, as other engines do it."""
    return F.floor(x * 10**places + 0.5) / F.lit(float(10**places))


def truncated(x: Column, places: int) -> Column:
    """Cut toward zero."""
    by = F.lit(10**places)
    return F.when(x >= 0, F.floor(x * by)).otherwise(F.ceil(x * by)) / by


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def resample(samples: Column, from_rate: float, to_rate: float) -> Column:
    """Samples at another rate by linear interpolation between neighbours; the last one stands for what follows it."""
    ratio, n = from_rate / to_rate, F.size(samples)
    length = F.floor(n / F.lit(ratio) + 0.5).cast("int")

    def at(i: Column) -> Column:
        place = i * F.lit(ratio)
        index = F.floor(place).cast("int")
        share = place - index
        return F.get(samples, index) * (1 - share) + F.get(samples, F.least(index + 1, n - 1)) * share

    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1), at)).otherwise(F.array().cast("array<double>"))


def pcm16(samples: Column) -> Column:
    """Samples held to -1 to 1 as 16-bit integers, cut toward zero."""
    held = F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    return F.transform(held, lambda x: (x * F.when(x < 0, 32768.0).otherwise(32767.0)).cast("int"))
