"""Copies hidden by formatting: an incremental ledger of canonical keys.

The ledger holds one row per canonical key: how many records carry it and the earliest of them. It is
bucketed by key hash. A batch is first aggregated to one row per key (map-side partial counts, so a
key that holds a third of all rows never travels row by row); only the buckets the batch touches are
read, full-outer-joined with it and written as a new generation. Untouched buckets stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.session import drop_path, materialize, release, scratch

LEDGER_SCHEMA = "src_table string, ckey binary, copies bigint, keep_id string, bucket int"


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("src_table", "ckey"), F.lit(buckets)).cast("int")


def batch_counts(records: DataFrame) -> DataFrame:
    """One row per key of a batch: number of records and the smallest id."""
    return records.groupBy("src_table", "ckey").agg(F.count("*").alias("copies"), F.min("id").alias("keep_id"))


def merge(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Add a batch's counts to the ledger rows of its buckets and keep the earliest representative."""
    b = batch.select("src_table", "ckey", F.col("copies").alias("b_copies"), F.col("keep_id").alias("b_keep"))
    return old.join(b, ["src_table", "ckey"], "full_outer").select(
        "src_table",
        "ckey",
        (F.coalesce("copies", F.lit(0)) + F.coalesce("b_copies", F.lit(0))).alias("copies"),
        F.least("keep_id", "b_keep").alias("keep_id"),
    )


@dataclass
class Ledger:
    """A bucketed ledger in the shared folder. Only its map of bucket to folder lives in the driver,
    which has as many entries as there are buckets."""

    spark: SparkSession
    buckets: int = 8
    paths: dict[int, str] = field(default_factory=dict)
    root: str = ""

    def __post_init__(self):
        self.root = self.root or scratch(self.spark, "ledger")

    def read(self, only: list[int] | None = None) -> DataFrame:
        at = [p for b, p in self.paths.items() if only is None or b in only]
        schema = ", ".join(LEDGER_SCHEMA.split(", ")[:-1])
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def add(self, records: DataFrame, generation: int) -> None:
        """Fold one batch of (src_table, id, ckey) records in. A batch must not be added twice."""
        batch = materialize(batch_counts(records).withColumn("bucket", bucket_of(self.buckets)), "ledger-batch")  # read twice
        gen = f"{self.root}/g{generation}"
        if self.paths:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most `buckets` rows
            merged = merge(self.read(touched), batch).withColumn("bucket", bucket_of(self.buckets))
        else:
            merged = batch
        merged.repartition(self.buckets, "bucket").write.partitionBy("bucket").option("compression", "lz4").parquet(gen)
        for row in self._buckets_of(gen):
            old_path = self.paths.get(row)
            self.paths[row] = f"{gen}/bucket={row}"
            if old_path:
                drop_path(self.spark, old_path)
        release(batch)

    def _buckets_of(self, gen: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(gen)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [int(n[7:]) for n in names if n.startswith("bucket=")]


def copies(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """(src_table, keep_id, copy_id) for every record whose key the ledger counts at least twice.

    The ledger is unique per key, so a hot key's records may be split over tasks by AQE.
    """
    multi = ledger.filter(F.col("copies") > 1).select("src_table", "ckey", "keep_id")
    return records.join(multi, ["src_table", "ckey"]).filter(F.col("id") != F.col("keep_id")).select(
        "src_table", "keep_id", F.col("id").alias("copy_id")
    )
