"""Resumable state in the shared folder: upserts, retry queue, pending work, boundary rebuilds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.functions.dates import backoff


def new_rows(batch: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return batch.join(known.select(*key).distinct(), key, "left_anti")


def insert_ignore(state: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """State plus the batch's rows of new keys; equal keys in the batch count once (the smallest row)."""
    rest = [c for c in state.columns if c not in key]
    one = batch.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return state.unionByName(new_rows(one, state, key).select(*state.columns))


def upsert(state: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """Full outer merge: batch values win where the batch has the key."""
    rest = [c for c in state.columns if c not in key]
    b = batch.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_hit"))
    return state.join(b, key, "full_outer").select(*key, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def conditional_update(state: DataFrame, hits: DataFrame, key: list[str], changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE EXISTS: changed columns only on rows whose key is among the hits."""
    h = hits.select(*key).distinct().withColumn("_hit", F.lit(True))
    return state.join(h, key, "left").select(*[F.when(F.col("_hit"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns])


def one_active_violations(df: DataFrame, key: list[str], active: Column) -> DataFrame:
    """Keys with more than one active row."""
    return df.filter(active).groupBy(*key).agg(F.count("*").alias("n_active")).filter("n_active > 1")


def retry_queue(queue: DataFrame, outcomes: DataFrame, key: str, maximum: int, base_seconds: int) -> DataFrame:
    """Next queue (key, attempts, status, next_at): successes leave, failures wait twice as long each
    time until the maximum, untouched entries are carried."""
    q = queue.select(key, F.col("attempts").alias("_q"), F.col("status").alias("_s"), F.col("next_at").alias("_n"))
    j = q.join(outcomes.select(key, "failed", "at"), key, "full_outer").filter(F.coalesce("failed", F.lit(True)))
    n = F.when(F.col("failed"), F.coalesce("_q", F.lit(0)) + 1).otherwise(F.col("_q"))
    return j.select(
        key, n.cast("int").alias("attempts"),
        F.when(F.col("failed"), F.when(n >= maximum, "exhausted").otherwise("waiting")).otherwise(F.col("_s")).alias("status"),
        F.when(F.col("failed") & (n < maximum), backoff(F.col("at"), n, base_seconds)).otherwise(F.when(F.col("failed").isNull(), F.col("_n"))).alias("next_at"),
    )


def pending(source: DataFrame, done: DataFrame, key: list[str], changed_at: str, algorithm: str) -> DataFrame:
    """Rows never processed, changed since, or processed by another algorithm version."""
    d = done.select(*key, F.col("processed_at").alias("_p"), F.col("algorithm").alias("_a"))
    return source.join(d, key, "left").filter(F.col("_p").isNull() | (F.col(changed_at) > F.col("_p")) | ~F.col("_a").eqNullSafe(F.lit(algorithm))).drop("_p", "_a")


def touched_boundaries(rows: DataFrame, changed: DataFrame, boundary: list[str]) -> DataFrame:
    """All rows of the boundaries that a change touches."""
    return rows.join(changed.select(*boundary).distinct(), boundary, "left_semi")


def keep_last_good(previous: DataFrame, current: DataFrame, source: str) -> DataFrame:
    """Rows of the current run; sources that brought nothing keep their previous rows."""
    return current.unionByName(previous.join(current.select(source).distinct(), source, "left_anti"))


def audit(before: DataFrame, after: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """(key, field, old, new) of every changed field."""
    a = before.select(*key, *[F.col(c).cast("string").alias(f"_o{n}") for n, c in enumerate(cols)])
    b = after.select(*key, *[F.col(c).cast("string").alias(f"_n{n}") for n, c in enumerate(cols)])
    e = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"_o{n}").alias("old_value"), F.col(f"_n{n}").alias("new_value")) for n, c in enumerate(cols)])
    return a.join(b, key).select(*key, F.inline(F.filter(e, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))))


def revert(current: DataFrame, log: DataFrame, key: list[str], col: str) -> DataFrame:
    """Undo logged changes of one column where the value is still the one the change set."""
    undo = log.select(*key, F.col("old_value").alias("_o"), F.col("new_value").alias("_n"), F.lit(True).alias("_hit"))
    same = F.col("_hit") & F.col(col).cast("string").eqNullSafe(F.col("_n"))
    return current.join(undo, key, "left").withColumn(col, F.when(same, F.col("_o")).otherwise(F.col(col))).drop("_o", "_n", "_hit")


class StageTable:
    """A stage's output keyed by the hash of its inputs: reused while the key stands, else made again."""

    def __init__(self, spark: SparkSession, root: str, stage: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{stage}"

    def run(self, key: str, make) -> DataFrame:
        at = f"{self.path}/{key}"
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            make().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)


def carry_forward(new: DataFrame, old: DataFrame, fingerprint: str, decision: str, fields: list[str]) -> DataFrame:
    """Decisions of old rows on new rows of the same decision fingerprint; an exported decision comes
    back as approved. Fingerprints decided differently before carry nothing."""
    d = F.when(F.col(decision) == "exported", "approved").otherwise(F.col(decision))
    o = old.filter(F.col(decision).isNotNull()).groupBy(fingerprint).agg(
        F.count_distinct(d).alias("_n"), F.min(d).alias("_d"), *[F.min_by(f, F.struct(decision, f)).alias(f"_{f}") for f in fields]
    ).filter("_n = 1")
    j = new.join(o, fingerprint, "left")
    return j.select(*[F.coalesce(F.col("_d"), F.col(decision)).alias(decision) if c == decision else F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in new.columns], F.col("_d").isNotNull().alias("carried"))


def invalidate(groups: DataFrame, members: DataFrame, changed: DataFrame, group: str, key: str) -> DataFrame:
    """Groups with a changed member go back to needs_review."""
    hit = members.join(changed.select(key).distinct(), key, "left_semi").select(group).distinct().withColumn("_hit", F.lit(True))
    return groups.join(hit, group, "left").withColumn("status", F.when(F.col("_hit"), "needs_review").otherwise(F.col("status"))).drop("_hit")


def approved_unchanged(current: DataFrame, approvals: DataFrame, key: str, content: Column) -> DataFrame:
    """Approved rows whose content hash is still the approved one."""
    return current.withColumn("_h", F.sha2(content, 256)).join(approvals.select(key, F.col("content_sha256").alias("_a")), key).filter(F.col("_h") == F.col("_a")).drop("_h", "_a")


def resume(source: DataFrame, done: DataFrame, key: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(next rows in key order up to the limit, one row with what remains after them)."""
    left = source.join(done.select(key).distinct(), key, "left_anti")
    batch = left.orderBy(key).limit(limit)
    return batch, left.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("n_remaining"))
