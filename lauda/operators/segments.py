"""Checks of segmented documents: number sequences, answer-grid choice, section expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lauda.functions import text as t


def number_exceptions(found: DataFrame, expected: DataFrame, key: str, number: str, order: str) -> DataFrame:
    """(key, number, exception) against expected ranges (key, first, last): missing, duplicate,
    out_of_range, out_of_order. Expected numbers are a sequence per key and meet the found ones by an
    anti-join, so neither side is gathered."""
    want = expected.select(key, F.explode(F.sequence("first", "last")).alias(number))
    have = found.filter(F.col(number).isNotNull()).select(key, number, order)
    missing = want.join(have.select(key, number).distinct(), [key, number], "left_anti").withColumn("exception", F.lit("missing"))
    twice = have.groupBy(key, number).agg(F.count("*").alias("_n")).filter("_n > 1").select(key, number, F.lit("duplicate").alias("exception"))
    outside = have.join(expected, key).filter(~F.col(number).between(F.col("first"), F.col("last"))).select(key, number, F.lit("out_of_range").alias("exception")).distinct()
    w = Window.partitionBy(key).orderBy(order)
    disorder = have.withColumn("_b", F.lag(number).over(w) > F.col(number)).filter("_b").select(key, number, F.lit("out_of_order").alias("exception")).distinct()
    return missing.unionByName(twice).unionByName(outside).unionByName(disorder)


def choose_grid(grids: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(doc, grid) per wanted (doc, variant, turn, role): variant equal or unsaid, turn words overlap
    where grids name turns, then the label that shares most role words; ties stay open."""
    heads = grids.select(key, "grid", "label", "variant", "turn").distinct().withColumnsRenamed({"variant": "_v", "turn": "_t"})
    words = lambda c: t.tokens(F.coalesce(F.col(c), F.lit("")))
    j = wanted.join(heads, key).filter(F.col("variant").isNull() | F.col("_v").isNull() | (F.col("variant") == F.col("_v")))
    j = j.filter(F.col("turn").isNull() | F.col("_t").isNull() | F.arrays_overlap(words("turn"), words("_t")))
    j = j.withColumn("_s", F.size(F.array_intersect(words("role"), words("label"))))
    top = j.groupBy(key).agg(F.max("_s").alias("_m"))
    best = j.join(top, key).filter("_s = _m").groupBy(key).agg(F.count("*").alias("_n"), F.min("grid").alias("grid"))
    return best.select(key, F.when(F.col("_n") == 1, F.col("grid")).alias("grid"))


def segmentation_metrics(found: DataFrame, expected: DataFrame, key: str, number: str) -> DataFrame:
    """Per key: precision and coverage of the found numbers."""
    want = expected.select(key, F.explode(F.sequence("first", "last")).alias(number), F.lit(1).alias("_w"))
    have = found.select(key, number, F.lit(1).alias("_h")).distinct()
    j = want.join(have, [key, number], "full_outer").groupBy(key).agg(F.count("_w").alias("n_expected"), F.count("_h").alias("n_found"), F.count_if(F.col("_w").isNotNull() & F.col("_h").isNotNull()).alias("n_matched"))
    return j.select("*", F.round(F.try_divide("n_matched", "n_found"), 6).alias("precision"), F.round(F.try_divide("n_matched", "n_expected"), 6).alias("coverage"))
