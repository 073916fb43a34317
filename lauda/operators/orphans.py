"""References to records that do not exist, kept as signed counts per key.

Two delta streams feed one keyed state: +1/-1 per reference taken up or given up, +1/-1 per target
row that comes to exist or is deleted. A key is an orphan while its reference count is positive and
its existence count is not. Deltas come in batches by period. A batch is summed per key and appended to
the state, a table bucketed by key, so nothing older is shuffled again; the batch's references are then
judged against the keys of the state that they touch, and those that find no existence at their own
moment become suspects. When all batches are in, the state names the reason of each suspect: its key was
never born (missing), was born after the record (late), or was gone before it (deleted).

A suspect can only be cleared by what comes later, never missed: a reference belongs to the batch of its
own moment or its delivery, whichever is later, and every delta up to that moment is in by then.

Edge cases: a null or blank reference is no reference; keys are compared trimmed and in lower case;
redelivered rows (same id) count once, the last delivered one, and what an earlier delivery referred to is
given up (-1); a target without created_at counts as always there; a record without created_at has a null
period, belongs to the first batch and can only be `missing`; a key with several target rows exists while
any of them does; empty tables give empty results. Only the named columns are read, so extra or clashing
columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.buckets import Bucketed, buckets_for
from lauda.session import materialize, release, scratch

STATE_COLUMNS = ["space", "key", "refs", "alive", "born", "gone"]
#: Batch of what carries no time: before all others.
NO_PERIOD = 0


@dataclass(frozen=True)
class Reference:
    """One referring field: its table name in the report, columns and the key space it points into."""

    ref_table: str
    field: str
    space: str
    version: str | None = None  # column that orders redelivered rows of one id


def norm_key(c: Column) -> Column:
    """A key as it is compared: outer white space and letter case ignored, blank as null."""
    k = F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))
    return F.when(k != "", k)


def period_of(*moments: Column) -> Column:
    """The batch of what becomes known at the latest of these moments."""
    latest = F.greatest(*[F.year(m) for m in moments]) if len(moments) > 1 else F.year(moments[0])
    return F.coalesce(latest, F.lit(NO_PERIOD))


def _delivered(df: DataFrame, ref: Reference) -> DataFrame:
    ver = F.col(ref.version) if ref.version else F.lit(None).cast("timestamp")
    return df.select(F.col("id").alias("record_id"), norm_key(F.col(ref.field)).alias("key"), F.col("created_at").alias("at"), ver.alias("ver"))


def references(df: DataFrame, ref: Reference) -> DataFrame:
    """(ref_table, record_id, space, key, at, period): one row per record with a reference that is not blank.

    Only a table that can hold redelivered rows pays for the aggregation by id.
    """
    rows = _delivered(df, ref).withColumn("period", period_of(F.col("at"), F.col("ver")))
    if ref.version:
        rows = rows.groupBy("record_id").agg(
            F.max_by(F.struct("key", "at"), F.struct(F.col("ver").isNotNull(), F.col("ver"), F.col("key"), F.col("at"))).alias("last"), F.max("period").alias("period")
        ).select("record_id", "last.key", "last.at", "period")
    return rows.filter(F.col("key").isNotNull()).select(
        F.lit(ref.ref_table).alias("ref_table"), "record_id", F.lit(ref.space).alias("space"), "key", "at", "period"
    )


def superseded(df: DataFrame, ref: Reference) -> DataFrame:
    """(space, key, taken, given): references of earlier deliveries that the last one no longer holds, with
    the batches in which they were taken up and given up. Nearly all records have none."""
    rows = _delivered(df, ref)
    last = F.max_by(F.struct("key"), F.struct(F.col("ver").isNotNull(), F.col("ver"), F.col("key"), F.col("at")))
    many = rows.groupBy("record_id").agg(last.alias("last"), F.max(period_of(F.col("ver"))).alias("given"), F.count_distinct("key").alias("n")).filter("n > 1")
    old = rows.join(many.select("record_id", F.col("last.key").alias("last_key"), "given"), "record_id").filter(F.col("key").isNotNull() & ~F.col("key").eqNullSafe(F.col("last_key")))
    return old.groupBy("record_id", "key").agg(F.min(period_of(F.col("ver"))).alias("taken"), F.max("given").alias("given")).select(F.lit(ref.space).alias("space"), "key", "taken", "given")


def target_deltas(df: DataFrame, space: str) -> DataFrame:
    """Existence deltas of one target table: +1 when a row comes to exist, -1 when it is deleted; born and
    gone are kept for judging a moment."""
    rows = df.select(norm_key(F.col("id")).alias("key"), "created_at", "deleted_at").filter(F.col("key").isNotNull())
    kind = df.schema["created_at"].dataType
    always, never = F.lit("0001-01-01").cast(kind), F.lit(None).cast(kind)
    count = lambda n: F.lit(n).cast("bigint")
    row = lambda alive, born, gone, period: F.struct(count(0).alias("refs"), count(alive).alias("alive"), born.alias("born"), gone.alias("gone"), period.alias("period"))
    comes = row(1, F.coalesce("created_at", always), never, period_of(F.col("created_at")))
    goes = F.when(F.col("deleted_at").isNotNull(), row(-1, never, F.col("deleted_at").cast(kind), period_of(F.col("deleted_at"), F.col("created_at"))))
    return rows.select(F.lit(space).alias("space"), "key", F.inline(F.array_compact(F.array(comes, goes))))


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Reference deltas: sign is +1 for references taken up, -1 for references given up."""
    null_ts = F.lit(None).cast(refs.schema["at"].dataType if "at" in refs.columns else "timestamp_ntz")
    by = [c for c in ("space", "key", "period") if c in refs.columns]
    return refs.groupBy(*by).agg((F.count("*") * sign).alias("refs")).select(
        "space", "key", "refs", F.lit(0).cast("bigint").alias("alive"), null_ts.alias("born"), null_ts.alias("gone"), *by[2:]
    )


def fold_deltas(deltas: DataFrame) -> DataFrame:
    """Sum deltas per key; map-side partial sums keep a hot key from travelling row by row."""
    return deltas.groupBy("space", "key").agg(
        F.sum("refs").alias("refs"),
        F.sum("alive").alias("alive"),
        F.min("born").alias("born"),
        # a living row of the key means it is not gone
        F.when(F.sum("alive") <= 0, F.max("gone")).alias("gone"),
    )


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """New state from the old one and a batch of deltas: full outer join on the key, counts added."""
    d = fold_deltas(deltas).select(*[F.col(c).alias(f"d_{c}" if c not in ("space", "key") else c) for c in STATE_COLUMNS])
    both = state.join(d, ["space", "key"], "full_outer")
    total = {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"d_{c}"), F.lit(0)) for c in ("refs", "alive")}
    return both.select(
        "space",
        "key",
        total["refs"].alias("refs"),
        total["alive"].alias("alive"),
        F.least("born", "d_born").alias("born"),
        F.when(total["alive"] <= 0, F.greatest("gone", "d_gone")).alias("gone"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphan report: keys with positive references and zero existence."""
    return state.filter((F.col("refs") > 0) & (F.col("alive") <= 0)).select(
        F.col("space").alias("key_space"),
        F.col("key").alias("ref_key"),
        F.col("refs").alias("n_refs"),
        F.when(F.col("born").isNull(), "missing").otherwise("deleted").alias("reason"),
    )


class OrphanState:
    """Signed counts per key, persisted as an append-only table of summed deltas bucketed by key."""

    KEY = ["space", "key"]

    def __init__(self, spark: SparkSession, rows: int = 0, kind: str = "timestamp_ntz"):
        schema = f"space string, key string, refs bigint, alive bigint, born {kind}, gone {kind}"
        self.deltas = Bucketed(spark, "orphans", schema, self.KEY, buckets_for(spark, rows))

    def append(self, batch: DataFrame) -> None:
        """Fold one batch of deltas in: one row per key of the batch is added."""
        self.deltas.append(fold_deltas(batch.select(*STATE_COLUMNS)))

    def current(self, keys: DataFrame | None = None) -> DataFrame:
        """One row per key, of all keys or of those given: summed inside the buckets."""
        rows = self.deltas.read()
        return fold_deltas(rows if keys is None else rows.join(keys, self.KEY, "left_semi"))

    def drop(self) -> None:
        self.deltas.drop()


def suspects(refs: DataFrame, state: OrphanState) -> DataFrame:
    """References of one batch that find no existence of their key at their own moment. Keys are made
    distinct before they meet the state, so a hot key costs one row there and its references may be split."""
    known = state.current(refs.select(*OrphanState.KEY).distinct()).filter(F.col("born").isNotNull()).select(*OrphanState.KEY, "born", "gone")
    there = (F.col("born") <= F.col("at")) & ~F.coalesce(F.col("gone") <= F.col("at"), F.lit(False))
    unknown = F.col("at").isNull() & F.col("born").isNotNull()  # without a moment only a missing key is an orphan
    return refs.join(known, OrphanState.KEY, "left").filter(~F.coalesce(there | unknown, F.lit(False))).select(*refs.columns)


def follow(refs: DataFrame, given_up: DataFrame, targets: DataFrame) -> tuple[DataFrame, OrphanState]:
    """(suspects, state) after all batches of references, references given up and existence deltas."""
    spark = refs.sparkSession
    taken = refs.unionByName(given_up.select("space", "key", F.col("taken").alias("period")), allowMissingColumns=True)
    lost = given_up.select("space", "key", F.col("given").alias("period"))
    log = materialize(targets.unionByName(reference_deltas(taken)).unionByName(reference_deltas(lost, -1)), "orphan-deltas", "period")
    kept = materialize(refs, "orphan-refs", "period")
    sizes = {r.period: r["count"] for r in log.groupBy("period").count().collect()}  # one entry per period
    state = OrphanState(spark, sum(sizes.values()), targets.schema["born"].dataType.simpleString())
    paths = []
    for period in sorted(sizes):
        state.append(log.filter(F.col("period") == period))
        paths.append(scratch(spark, "suspects"))
        suspects(kept.filter(F.col("period") == period), state).write.parquet(paths[-1])
    release(log)
    schema = refs.schema
    return (spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)), state


def orphan_records(refs: DataFrame, existence: DataFrame) -> DataFrame:
    """(ref_table, record_id, reason, ref_period) of records whose reference leads nowhere.

    existence is the folded state of the targets: one row per key, so the join adds no rows and AQE
    may split the referring side of a hot key freely.
    """
    at, born, gone = F.col("at"), F.col("born"), F.col("gone")
    reason = (
        F.when(born.isNull(), "missing")
        .when(born > at, "late")
        .when(gone <= at, "deleted")
    )
    known = existence.filter(F.col("born").isNotNull()).select("space", "key", "born", "gone")
    return (
        refs.join(known, ["space", "key"], "left")
        .select("ref_table", "record_id", reason.alias("reason"), F.date_format("at", "yyyy-MM").alias("ref_period"))
        .filter(F.col("reason").isNotNull())
    )


def orphans_per_period(records: DataFrame) -> DataFrame:
    """The report per table, period and reason."""
    return records.groupBy("ref_table", "ref_period", "reason").agg(F.count("*").alias("n_records"))
