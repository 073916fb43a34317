"""Intervals and tests as column expressions, allocation as a DataFrame operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """100 * part / whole rounded, 0 where the whole is 0."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def wilson(successes: Column, trials: Column, digits: int = 3) -> tuple[Column, Column]:
    """Wilson 95 % interval in percent, clamped to 0..100; 0 without trials."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials.cast("double"))
    z2 = Z95 * Z95
    centre = p + F.try_divide(F.lit(z2), 2 * n)
    spread = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z2), n)
    lo, hi = F.try_divide(centre - spread, scale), F.try_divide(centre + spread, scale)
    low, high = F.round(F.greatest(lo, F.lit(0.0)) * 100, digits), F.round(F.least(hi, F.lit(1.0)) * 100, digits)
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p of b and c discordant pairs: twice the smaller binomial tail.

    The tail's terms are built one from the other in logarithms, so large counts don't underflow.
    """
    n, k = (b + c).cast("double"), F.least(b, c)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.least(F.lit(1.0), 2 * F.aggregate(steps, start, add)["sum"])


def largest_remainder(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Add `share`: total seats by largest remainder (fraction, then size, then key)."""
    everything = F.sum(size).over(Window.partitionBy(F.lit(0)))  # one row per stratum
    s = sizes.withColumn("_exact", F.col(size) * F.lit(total) / everything).withColumn("_floor", F.floor("_exact"))
    left = F.lit(total) - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(size).desc(), F.col(key)))
    return s.withColumn("share", (F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).cast("int")).drop("_exact", "_floor")


def token_cost(text: Column, price: float) -> tuple[Column, Column]:
    """Estimated tokens (a third of the bytes, at least 1) and their price."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 3).cast("int"))
    return n, n * F.lit(price)
