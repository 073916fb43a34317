"""Window, ordering and batching operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.session import checked_broadcast, materialize


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row per key by an aggregation on a struct: combined map-side, unlike a window."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in a total order, combined map-side."""
    rest = [c for c in df.columns if c not in key]
    one = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*key).agg(one).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest])


def representative(df: DataFrame, key: list[str], rank: list[Column], value: str) -> DataFrame:
    """Representative per group: the row of smallest rank tuple."""
    return df.groupBy(*key).agg(F.min_by(value, F.struct(*rank)).alias("representative"), F.count("*").alias("n_rows"))


def with_neighbours(df: DataFrame, part: list[str], order: str, cols: list[str]) -> DataFrame:
    """Add prev_c and next_c of the rows before and after within a part.

    A window would put a whole part into one task. Here rows are range partitioned by (part, order), so
    a part of any size spreads over tasks; neighbours inside a range come from a window over the
    range, and only the outermost row of every range (two per partition) crosses over.
    """
    d = materialize(df.repartitionByRange(*part, order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_p", *part).orderBy(order)
    out = d
    for c in cols:
        out = out.withColumns({f"prev_{c}": F.lag(c).over(w), f"next_{c}": F.lead(c).over(w)})
    out = out.withColumns({"_first": F.row_number().over(w) == 1, "_last": F.lead(F.lit(1)).over(w).isNull()})
    key = F.struct(*part, order)
    row = F.struct(*part, *cols)
    ends = d.groupBy("_p").agg(F.min_by(row, key).alias("lo"), F.max_by(row, key).alias("hi"))  # a row per partition
    by = Window.partitionBy(F.lit(0)).orderBy("_p")
    edge = ends.select("_p", F.lag("hi").over(by).alias("before"), F.lead("lo").over(by).alias("after"))
    out = out.join(checked_broadcast(edge), "_p")
    same = lambda side: F.struct(*[F.col(f"{side}.{p}") for p in part]).eqNullSafe(F.struct(*part)) if part else F.lit(True)
    take_prev, take_next = F.col("_first") & F.col("before").isNotNull() & same("before"), F.col("_last") & F.col("after").isNotNull() & same("after")
    for c in cols:
        out = out.withColumns(
            {f"prev_{c}": F.when(take_prev, F.col(f"before.{c}")).otherwise(F.col(f"prev_{c}")), f"next_{c}": F.when(take_next, F.col(f"after.{c}")).otherwise(F.col(f"next_{c}"))}
        )
    return out.drop("_p", "_first", "_last", "before", "after")


def propagate_between(df: DataFrame, part: list[str], order: str, value: str, confidence: str, floor: float = 0.8, given: float = 0.78) -> DataFrame:
    """Fill a null value when the rows before and after agree and both are confident enough; read from
    the rows as they were, so one pass is exact."""
    d = with_neighbours(df, part, order, [value, confidence])
    before, after = F.col(f"prev_{value}"), F.col(f"next_{value}")
    sure = (F.col(f"prev_{confidence}") >= floor) & (F.col(f"next_{confidence}") >= floor)
    fill = F.col(value).isNull() & (before == after) & sure
    return d.withColumns(
        {f"{value}_filled": F.when(fill, before).otherwise(F.col(value)), "filled_confidence": F.when(fill, F.lit(given)).otherwise(F.col(confidence)), "was_filled": F.coalesce(fill, F.lit(False))}
    ).drop(*[f"{side}_{c}" for side in ("prev", "next") for c in (value, confidence)])


def out_of_order(df: DataFrame, part: list[str], order: str, number: str) -> DataFrame:
    """Whether a sequence per part ever fails to rise."""
    d = with_neighbours(df, part, order, [number])
    return d.withColumn("_bad", F.coalesce(F.col(f"prev_{number}") >= F.col(number), F.lit(False))).groupBy(*part).agg(F.max("_bad").alias("out_of_order"), F.count("*").alias("n_rows"))


def version_chain(df: DataFrame, key: list[str], content: str, at: str) -> DataFrame:
    """(key, content, version_no, predecessor): contents numbered by first appearance."""
    first = df.groupBy(*key, content).agg(F.min(at).alias("first_at"))
    w = Window.partitionBy(*key).orderBy("first_at", content)
    return first.withColumns({"version_no": F.row_number().over(w), "predecessor": F.lag(content).over(w)})


def running_block(df: DataFrame, part: list[str], order: str, heading: Column) -> DataFrame:
    """Heading that a line inherits from the last heading before it."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block", F.last(heading, ignorenulls=True).over(w))


def repeated_on_pages(df: DataFrame, doc: str, page: str, token: str) -> DataFrame:
    """Tokens of a document that stand on more than one page."""
    return df.groupBy(doc, token).agg(F.count_distinct(page).alias("n_pages")).filter("n_pages > 1")


def per_stratum(df: DataFrame, stratum: list[str], key: str, seed: str) -> DataFrame:
    """One row per stratum: the one of smallest seeded hash."""
    rest = [c for c in df.columns if c not in stratum]
    h = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    return df.groupBy(*stratum).agg(F.min_by(F.struct(*rest), F.struct(h, F.col(key))).alias("_one")).select(*stratum, *[F.col(f"_one.{c}").alias(c) for c in rest])


def folded_order(df: DataFrame, *cols: str) -> DataFrame:
    """Sort by folded text, nulls last."""
    from lauda.functions.text import fold

    return df.orderBy(*[x for c in cols for x in (F.col(c).isNull(), fold(F.col(c)))])


def recent(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The last n rows, oldest first."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n).orderBy(at, tie)


def quota(df: DataFrame, part: list[str], kind: Column, order: list[str], limit: int) -> DataFrame:
    """At most limit rows per part, of which max(1, min(4, limit // 4)) are reserved for the kind."""
    reserved = max(1, min(4, limit // 4))
    w = Window.partitionBy(*part, "_kind").orderBy(*order)
    d = df.withColumn("_kind", F.coalesce(kind, F.lit(False))).withColumn("_n", F.row_number().over(w))
    return d.filter(F.when(F.col("_kind"), F.col("_n") <= reserved).otherwise(F.col("_n") <= limit - reserved)).drop("_kind", "_n")


def batches(df: DataFrame, order: list[str], size: int, part: list[str] | None = None) -> DataFrame:
    """Number rows into batches of at most `size`, per part or over all rows.

    Over all rows, ranges are counted first and numbered from their offsets, so no task sees them all.
    """
    if part:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn("batch_no", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    d = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    n = d.groupBy("_p").agg(F.count("*").alias("_c"))  # a row per partition
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = n.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return d.join(checked_broadcast(offset), "_p").withColumn("batch_no", F.floor((F.col("_o") + inside) / size).cast("int")).drop("_p", "_o")


def biggest_group(df: DataFrame, by: list[str], group: str) -> DataFrame:
    """The most frequent group value per key, ties to the smallest value."""
    n = df.groupBy(*by, group).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by(F.struct(group, "n"), F.struct("n", F.lit(0))).alias("_t"), F.min_by(F.struct(group, "n"), F.struct(-F.col("n"), F.col(group))).alias("_b")).select(
        *by, F.col(f"_b.{group}").alias(group), F.col("_b.n").alias("n")
    )
