"""Counting operators: facets, group reports, multi-dimension counters, consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.functions import stats
from lauda.functions import text as t


def skip_one_facets(df: DataFrame, facets: dict[str, Column], predicates: dict[str, Column]) -> DataFrame:
    """(facet, value, n, selected): each facet counts its values under all predicates but its own.

    One scan: the predicates are booleans, every row is unpivoted to the facets it counts for, and
    one aggregation follows. The same plan holds for any number of facets.
    """
    marks = {n: F.coalesce(p, F.lit(False)) for n, p in predicates.items()}

    def others(facet: str) -> Column:
        ok = F.lit(True)
        for n, p in marks.items():
            if n != facet:
                ok = ok & p
        return ok

    entries = F.array(
        *[
            F.when(others(n), F.struct(F.lit(n).alias("facet"), v.cast("string").alias("value"), marks.get(n, F.lit(False)).alias("selected")))
            for n, v in facets.items()
        ]
    )
    rows = df.select(F.inline(F.filter(entries, lambda e: e.isNotNull() & e["value"].isNotNull())))
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"), F.max("selected").alias("selected"))


def multi_counts(df: DataFrame, dims: dict[str, Column], missing: str = "(none)") -> DataFrame:
    """(dimension, value, n): independent counters of all dimensions in one pass."""
    entries = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit(missing)).alias("value")) for n, c in dims.items()])
    return df.select(F.inline(entries)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def group_report(df: DataFrame, by: Column, states: dict[str, Column], missing: str = "(none)") -> DataFrame:
    """Rows and conditional counts per group; null groups get a label."""
    return df.groupBy(F.coalesce(by, F.lit(missing)).alias("grp")).agg(
        F.count("*").alias("n_total"), *[F.count_if(F.coalesce(p, F.lit(False))).alias(f"n_{n}") for n, p in states.items()]
    )


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field_name, n_filled, share) per column, one row each, from a single aggregation."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("n_filled"), F.round(F.try_divide(F.col(c), F.col("_n")), 6).alias("share")) for c in cols])))


def status_histogram(df: DataFrame, c: Column, domain: list[str]) -> DataFrame:
    """Counts for a closed set of values, zero included."""
    one = df.agg(*[F.count_if(F.coalesce(c == v, F.lit(False))).alias(f"c{n}") for n, v in enumerate(domain)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"c{n}").alias("n")) for n, v in enumerate(domain)])))


def element_histogram(df: DataFrame, arr: Column) -> DataFrame:
    """Counts of the elements of an array column."""
    return df.select(F.explode(arr).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def top_groups(df: DataFrame, cols: list[str], limit: int) -> DataFrame:
    """Most frequent value combinations with a total order."""
    n = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), *[F.col(c).asc_nulls_last() for c in cols]).limit(limit)


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows, distinct keys, surplus rows, keys that occur more than once."""
    per = df.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    return per.agg(
        F.sum("c").alias("n_rows"), F.count("*").alias("n_unique"), (F.sum("c") - F.count("*")).alias("n_surplus"), F.count_if(F.col("c") > 1).alias("n_repeated")
    )


def consensus(df: DataFrame, key: list[str], answer: Column, status: Column) -> DataFrame:
    """Group status from the sets of answers and statuses: conflict before incomplete before confirmed.

    Sets of a closed alphabet stay small however many rows a group has.
    """
    return df.groupBy(*key).agg(
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_set(answer)).alias("answers"),
        F.count_if(status == "missing").alias("n_missing"),
    ).select(
        *key, "n_rows", F.size("answers").alias("n_answers"),
        F.when(F.size("answers") > 1, "conflict").when(F.col("n_missing") > 0, "incomplete").when(F.size("answers") == 1, "confirmed").otherwise("needs_review").alias("group_status"),
    )


def merge_first(df: DataFrame, key: str, order: list[Column], cols: list[str]) -> DataFrame:
    """One row per key: the first value that isn't null of every column, and how many different folded
    values it had. min_by keeps it a single aggregation."""
    o = F.struct(*order)
    return df.groupBy(key).agg(
        F.count("*").alias("n_rows"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in cols],
        *[(F.count_distinct(t.fold(F.col(c).cast("string"))) > 1).alias(f"{c}_differs") for c in cols],
    )


def ordered_distinct(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Distinct values per key in order of first appearance: reduced to one row per value first."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]), "|").alias("vals"))


def document_rollup(df: DataFrame, key: str, included: Column, reason: Column) -> DataFrame:
    """Included and excluded rows per document with the sorted distinct reasons."""
    return df.groupBy(key).agg(
        F.count_if(included).alias("n_included"),
        F.count_if(~included).alias("n_excluded"),
        F.array_join(F.array_sort(F.collect_set(F.when(~included, reason))), "|").alias("reasons"),
    )


def latency_table(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Count, sum with default, maximum with default, median and nearest-rank P95."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(value.cast("decimal(20,6)")), F.lit(0)).cast("double").alias("total"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("most"),
        F.round(F.median(value), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value._jc.toString()})").alias("p95"),
    )


def coverage(df: DataFrame, by: list[str], covered: Column) -> DataFrame:
    """Units, covered units and percent, zero-safe."""
    return df.groupBy(*by).agg(F.count("*").alias("n_units"), F.count_if(F.coalesce(covered, F.lit(False))).alias("n_covered")).withColumn(
        "percent", stats.percent(F.col("n_covered"), F.col("n_units"))
    )


def one_row(*frames: DataFrame) -> DataFrame:
    """Independent one-row aggregates side by side, joined on a constant key."""
    out = frames[0].withColumn("_one", F.lit(1))
    for f in frames[1:]:
        out = out.join(F.broadcast(f.withColumn("_one", F.lit(1))), "_one")  # one row each
    return out.drop("_one")


def facet_order(df: DataFrame) -> DataFrame:
    """Facet rows ranked by count and folded label."""
    w = Window.partitionBy("facet").orderBy(F.desc("n"), t.fold(F.col("value")), F.col("value"))
    return df.withColumn("rank", F.row_number().over(w))
