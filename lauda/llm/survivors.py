"""The best representative of a set of copies, chosen field by field.

Order among the rows that have a value: status, confidence, update time, then currency, then id.
Currency stands in for missing update times. From the rows that do carry times the operator learns which
value of a field tends to follow which (value transitions inside a set, in order of first appearance) and
keeps the majority direction of each pair. The learned precedences are layered topologically: a value's
level is one more than that of its latest predecessor, so A before B before C puts A below C even in a set
that has no B. Cycle rule: when no value without predecessor is left, the precedences of least margin among
those left are dropped. In a set the values of the highest level are the topologically latest ones.

Edge cases: null confidence and null times sort last; unknown status sorts after the known ones;
stand-ins for "not informed" are no value; a set in which no row has a value of a field gives no row
for it; ties end at the smallest id; a payload that doesn't parse takes no part; values without any learned
precedence have level -1, below all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.functions.text import fold
from lauda.session import checked_broadcast, materialize, release, scratch

FIELDS = ["matter", "subject", "level", "difficulty", "board", "organization", "role", "year", "explanation"]
STATUS_ORDER = ["exported", "approved", "pending", "exception", "rejected"]
#: What stands for "not informed", folded; texts without a letter or digit count too.
STAND_INS = ["n/d", "n/i", "s/i", "n/a", "na", "nd", "null", "none", "nan", "nao informado", "nao informada", "sem informacao", "nao consta", "nao se aplica"]


def field_values(payload: Column, fields: list[str] = FIELDS) -> Column:
    """Struct of the fields' texts, null where a value is absent, a stand-in or a year out of range."""
    schema = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_json(payload, schema)

    def clean(f: str) -> Column:
        raw = parsed[f]
        if f == "year":
            number = raw.try_cast("double")
            return F.when((number >= 1900) & (number <= 2100), raw)
        return F.when(raw.rlike(r"[\p{L}\p{N}]") & ~fold(raw).isin(STAND_INS), raw)

    return F.struct(*[clean(f).alias(f) for f in fields])


def status_rank(status: Column) -> Column:
    s = F.lower(F.regexp_replace(status, r"^[\s ]+|[\s ]+$", ""))
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), s).cast("int"), F.lit(0))


def _rank() -> Column:
    return F.coalesce(F.when(F.col("rank") == 0, 99).otherwise(F.col("rank")), F.lit(99))


def _doubt() -> Column:
    return F.coalesce(-F.col("confidence"), F.lit(float("inf")))


def _age() -> Column:
    return F.coalesce(-F.unix_micros(F.col("ver").cast("timestamp")), F.lit((1 << 63) - 1))


def order_key(level: Column | None = None, currency_first: Column | None = None) -> Column:
    """Struct whose minimum is the best row; where currency_first holds, the level goes before the time."""
    late = -F.coalesce(level, F.lit(-1)) if level is not None else F.lit(0)
    first = F.when(currency_first, late).otherwise(0) if currency_first is not None else F.lit(0)
    return F.struct(_rank(), _doubt(), first.alias("first"), _age(), late.alias("late"), F.col("id"))


def field_rows(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(group key, id, ..., field_name, value): one row per field that has a value, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"vals.{f}").alias("value")) for f in fields])
    return rows.select("ckey", "id", "rank", "confidence", "ver", F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def precedence(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(field_name, earlier, later, n, n_back): learned value precedence from rows that carry times.

    Values are first reduced to their first appearance per set, so the window runs over distinct
    values, not rows.
    """
    seen = (
        field_rows(rows.filter(F.col("ver").isNotNull()), fields)
        .groupBy("ckey", "field_name", F.xxhash64("value").alias("value"))
        .agg(F.min("ver").alias("first"))
    )
    w = Window.partitionBy("ckey", "field_name").orderBy("first", "value")
    steps = seen.select("field_name", F.lag("value").over(w).alias("earlier"), F.col("value").alias("later")).filter("earlier is not null")
    lo, hi = F.least("earlier", "later"), F.greatest("earlier", "later")
    counts = steps.groupBy("field_name", lo.alias("lo"), hi.alias("hi")).agg(
        F.count_if(F.col("earlier") < F.col("later")).alias("up"), F.count_if(F.col("earlier") > F.col("later")).alias("down")
    )
    up = F.col("up") > F.col("down")
    return counts.filter("up <> down").select(
        "field_name",
        F.when(up, F.col("lo")).otherwise(F.col("hi")).alias("earlier"),
        F.when(up, F.col("hi")).otherwise(F.col("lo")).alias("later"),
        F.greatest("up", "down").alias("n"),
        F.least("up", "down").alias("n_back"),
    )


def levels(learned: DataFrame) -> DataFrame:
    """(field_name, v, level): topological level of every value in the learned precedences.

    Values without predecessor are peeled off round by round, one written table a round, as many rounds as
    the longest chain of values is long; a round that peels none drops the weakest precedences left.
    """
    edges = materialize(learned.select("field_name", "earlier", "later", (F.col("n") - F.col("n_back")).alias("margin")), "precedence")
    spark = edges.sparkSession
    nodes = edges.select("field_name", F.col("earlier").alias("v")).unionByName(edges.select("field_name", F.col("later").alias("v"))).distinct()
    paths: list[str] = []
    left = materialize(nodes, "values")
    level = 0
    while True:
        follows = edges.select("field_name", F.col("later").alias("v"), F.lit(True).alias("_after")).distinct()
        marked = materialize(left.join(follows, ["field_name", "v"], "left"), "peel")
        free = marked.filter("_after is null").drop("_after")
        n = marked.agg(F.count_if(F.col("_after").isNull()).alias("free"), F.count("*").alias("all")).first()
        release(left)
        if not n["all"]:
            break
        left = marked.filter("_after").drop("_after")
        if n["free"]:
            paths.append(scratch(spark, "level"))
            free.select("field_name", "v", F.lit(level).alias("level")).write.parquet(paths[-1])
            if n["free"] == n["all"]:
                break
            kept = edges.join(free.withColumnRenamed("v", "earlier"), ["field_name", "earlier"], "left_anti")
            level += 1
        else:
            weakest = edges.groupBy("field_name").agg(F.min("margin").alias("least"))
            kept = edges.join(checked_broadcast(weakest), "field_name").filter("margin > least").drop("least")
        old, edges = edges, materialize(kept, "precedence")
        left = materialize(left, "values")
        release(old)
        release(marked)
    return spark.read.schema("field_name string, v bigint, level int").parquet(*paths) if paths else spark.createDataFrame([], "field_name string, v bigint, level int")


def with_levels(rows: DataFrame, layered: DataFrame) -> DataFrame:
    """Field rows with the level of their value, null where nothing was learned about it."""
    return rows.withColumn("v", F.xxhash64("value")).join(layered, ["field_name", "v"], "left").drop("v")


def best_rows(field_rows_: DataFrame, currency_first: bool = False) -> DataFrame:
    """(ckey, field_name, question_id, value): the best row of each set and field, map-side combined.

    currency_first: where a row that is otherwise equal to the best lacks a time, the topologically latest
    value goes before the latest time.
    """
    level = F.col("level") if "level" in field_rows_.columns else None
    rows, first = field_rows_, None
    if currency_first:
        top = rows.groupBy("ckey", "field_name").agg(F.min(F.struct(_rank().alias("r"), _doubt().alias("d"), F.col("ver").isNotNull().alias("t"))).alias("_top"))
        rows = rows.join(top, ["ckey", "field_name"])
        first = ~F.col("_top.t") & (_rank() == F.col("_top.r")) & (_doubt() == F.col("_top.d"))
    return rows.groupBy("ckey", "field_name").agg(F.min_by(F.struct("id", "value"), order_key(level, first)).alias("best")).select(
        "ckey", "field_name", F.col("best.id").alias("question_id"), F.col("best.value").alias("value")
    )


def currency_accuracy(rows: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(field_name, n_sets, n_decided, n_right, by_chance): precedence learned on half of the sets, the times
    of the other half hidden. Judged are sets with several values of a field and one last one; decided are
    those whose highest level is held by one value, right those where it is the value seen last. by_chance is
    what a random choice among the values of the decided sets would get right."""
    half = F.pmod(F.xxhash64("ckey"), F.lit(2))
    layered = levels(precedence(rows.filter(half == 0), fields))
    seen = field_rows(rows.filter((half == 1) & F.col("ver").isNotNull()), fields).groupBy("ckey", "field_name", F.xxhash64("value").alias("v")).agg(F.max("ver").alias("last"))
    known = seen.join(layered, ["field_name", "v"], "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    per = known.groupBy("ckey", "field_name").agg(F.count("*").alias("k"), F.max("level").alias("top"), F.max("last").alias("end"))
    both = known.join(per.filter("k > 1"), ["ckey", "field_name"])
    one = both.groupBy("ckey", "field_name").agg(
        F.first("k").alias("k"), F.count_if(F.expr("level = top")).alias("n_top"), F.count_if(F.expr("last = `end`")).alias("n_last"), F.count_if(F.expr("level = top and last = `end`")).alias("hit")
    ).filter("n_last = 1")
    decided = F.col("n_top") == 1
    return one.groupBy("field_name").agg(
        F.count("*").alias("n_sets"), F.count_if(decided).alias("n_decided"), F.count_if(decided & (F.col("hit") == 1)).alias("n_right"), F.round(F.sum(F.when(decided, 1 / F.col("k"))), 1).alias("by_chance")
    )
