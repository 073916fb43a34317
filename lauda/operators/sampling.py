"""Seeded, coverage-first sampling and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.functions import stats
from lauda.session import checked_broadcast


def seeded(seed: str, key: Column) -> Column:
    """Order that doesn't depend on partitions."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def stratified(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """Proportional sample: seats by largest remainder, rows of smallest seeded hash in each stratum."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    seats = stats.largest_remainder(sizes, stratum, "_size", total).select(stratum, "share")
    w = Window.partitionBy(stratum).orderBy(seeded(seed, F.col(key)), F.col(key))
    ranked = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= total)
    return ranked.join(checked_broadcast(seats), stratum).filter(F.col("_n") <= F.col("share")).drop("_n", "share")


def coverage_first(df: DataFrame, key: str, dims: dict[str, Column], target: int, seed: str) -> DataFrame:
    """(key, phase): one row per value of every dimension, then the smallest hashes up to the target."""
    h = seeded(seed, F.col(key))
    entries = F.array(*[F.struct(F.lit(n).alias("dim"), F.coalesce(c.cast("string"), F.lit("(none)")).alias("val")) for n, c in dims.items()])
    cover = df.select(key, h.alias("_h"), F.inline(entries)).groupBy("dim", "val").agg(F.min_by(key, F.struct("_h", key)).alias(key)).select(key).distinct()
    rest = df.select(key, h.alias("_h")).join(cover, key, "left_anti").orderBy("_h", key).limit(target)
    n = F.row_number().over(Window.orderBy("phase", "_h", key))  # at most the covered values plus the target
    both = cover.join(df.select(key, h.alias("_h")), key).select(key, "_h", F.lit(1).alias("phase")).unionByName(rest.select(key, "_h", F.lit(2).alias("phase")))
    return both.withColumn("_n", n).filter((F.col("phase") == 1) | (F.col("_n") <= target)).select(key, "phase")


def missing_patterns(df: DataFrame, cols: list[str]) -> DataFrame:
    """How often each combination of missing fields occurs."""
    gone = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])), ",")
    return df.groupBy(gone.alias("missing")).agg(F.count("*").alias("n"))


def assign_masks(df: DataFrame, key: str, fields: list[str], seed: str) -> DataFrame:
    """Which known field of each row is hidden in a test: chosen by seeded hash among the known ones,
    so no assignment depends on another and none hides what isn't known."""
    known = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    n = F.conv(F.substring(seeded(seed, F.col(key)), 1, 8), 16, 10).cast("bigint")
    return df.select(key, F.when(F.size(known) > 0, F.element_at(known, (F.pmod(n, F.size(known)) + 1).cast("int"))).alias("masked_field"))


def accuracy_table(df: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """Correct, total, percent and Wilson interval per group."""
    t = df.groupBy(*by).agg(F.count_if(F.coalesce(correct, F.lit(False))).alias("n_correct"), F.count("*").alias("n_total"))
    lo, hi = stats.wilson(F.col("n_correct"), F.col("n_total"))
    return t.withColumns({"accuracy": stats.percent(F.col("n_correct"), F.col("n_total")), "ci_low": lo, "ci_high": hi})


def acceptance(df: DataFrame, by: list[str], accepted: Column, correct: Column) -> DataFrame:
    """Accepted precision, coverage and review rate."""
    t = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(accepted).alias("n_accepted"), F.count_if(accepted & correct).alias("n_right"))
    return t.select(*by, "n", "n_accepted", stats.percent(F.col("n_right"), F.col("n_accepted")).alias("precision"), stats.percent(F.col("n_accepted"), F.col("n")).alias("coverage"), stats.percent(F.col("n") - F.col("n_accepted"), F.col("n")).alias("review_rate"))


def precision_coverage(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Matched over found and over expected, null on empty sides."""
    e = expected.select(*key, F.lit(1).alias("_e")).distinct()
    f = found.select(*key, F.lit(1).alias("_f")).distinct()
    j = e.join(f, key, "full_outer").agg(F.count("_e").alias("n_expected"), F.count("_f").alias("n_found"), F.count_if(F.col("_e").isNotNull() & F.col("_f").isNotNull()).alias("n_matched"))
    return j.select("*", F.round(F.try_divide("n_matched", "n_found"), 6).alias("precision"), F.round(F.try_divide("n_matched", "n_expected"), 6).alias("coverage"))
