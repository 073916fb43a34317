"""Session helpers: table loading, the shared folder, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a side may be broadcast. Checked against the optimizer's own statistics.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale directory, as lazily scanned parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has written below the shared folder and not removed yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, taken from spark.checkpoint.dir.

    A session on this machine alone that names none gets a temporary folder, remembered in the session;
    on a cluster the setting has to be there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: master {master} needs a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lauda-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("compression", "lz4")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lauda_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the table that materialize wrote for df, which must not be read again."""
    if path := getattr(df, "_lauda_path", None):
        drop_path(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Remove every folder that this process has written below the shared folder: to be called when the
    results of the queries so far have been read."""
    for path in list(_WRITTEN):
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder written by this engine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast df only when the optimizer proves it small; otherwise leave the choice to AQE."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def local_session(cpus: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LAUDA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
