"""Append-only tables bucketed by key in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lauda.session import drop_path, scratch

#: Rows of one bucket that a table is laid out for.
BUCKET_ROWS = 4_000_000


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Buckets for a table expected to hold so many rows, at least one per shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


class Bucketed:
    """A table that is only appended to. Joins and aggregations by its keys read it bucket by bucket: what
    is stored is never shuffled, the other side is shuffled to it."""

    def __init__(self, spark: SparkSession, name: str, schema: str, keys: list[str], buckets: int):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.path = scratch(spark, name)
        self.name = f"lauda_{name}_{uuid.uuid4().hex[:12]}"
        self.made = False

    def append(self, df: DataFrame) -> None:
        self.append_placed(df.repartition(self.buckets, *self.keys))

    def append_placed(self, rows: DataFrame) -> None:
        """Append rows that lie in the table's buckets already."""
        rows.write.mode("append").bucketBy(self.buckets, *self.keys).option("path", self.path).option("compression", "lz4").format("parquet").saveAsTable(self.name)
        self.made = True

    def read(self) -> DataFrame:
        return self.spark.table(self.name) if self.made else self.spark.createDataFrame([], self.schema)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_path(self.spark, self.path)
