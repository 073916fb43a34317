"""New batches against all history: digests, copies and near duplicates, load after load.

Two persisted states are probed and then appended by every load: a ledger of the keys seen so far (digest
in its plain spelling, copy key, set of word pairs) and the segment index for bounded edit distance
(segments.py). A load is shuffled to their buckets; the states themselves are never shuffled again and
no text or set of the history is worked through again.

Edge cases: a blank or null digest matches nothing; rows of one id are one record of its earliest
load; records that came in the same load don't make each other repeats; null loads count as load 0.
"""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.buckets import Bucketed, buckets_for
from lauda.llm.segments import SegmentIndex
from lauda.session import scratch


def plain_digest(c: Column) -> Column:
    """A digest in lower case hex without separators or algorithm prefix; null when blank."""
    d = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?", ""), r"[^0-9a-f]", "")
    return F.when(d != "", d)


def digest_rows(df: DataFrame, src: str, field: str) -> DataFrame:
    """(src_table, id, load_no, key): one row per record and spelling-free digest."""
    return (
        df.select("id", F.coalesce("load_no", F.lit(0)).alias("load_no"), plain_digest(F.col(field)).alias("key"))
        .filter("id is not null and key is not null")
        .groupBy("id", "key")
        .agg(F.min("load_no").alias("load_no"))
        .select(F.lit(src).alias("src_table"), "id", "load_no", F.xxhash64(F.lit("digest"), "key").alias("k1"), F.hash("key", F.lit("digest")).alias("k2"))
    )


def _read(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def loads_of(rows: DataFrame) -> list[int]:
    """The loads in order: one entry each."""
    return sorted(r.load_no for r in rows.select("load_no").distinct().collect())


def repeated_keys(rows: DataFrame) -> DataFrame:
    """(src_table, k1, k2, load_no): keys of each load that an earlier one brought.

    rows: (src_table, id, load_no, k1, k2), partitioned by load_no on disk. A load's keys are reduced to
    one row each before they meet the ledger, so a key that holds a third of a load costs one row.
    """
    spark = rows.sparkSession
    key = ["src_table", "k1", "k2"]
    ledger = Bucketed(spark, "keys", "src_table string, k1 bigint, k2 int", key, buckets_for(spark, rows.count()))
    paths: list[str] = []
    for load in loads_of(rows):
        mine = rows.filter(F.col("load_no") == load).groupBy(*key).agg(F.lit(load).alias("load_no"))
        if not ledger.made:
            ledger.append(mine.select(*key))
            continue
        paths.append(scratch(spark, "keys-of-load"))
        mine.join(ledger.read().withColumn("known", F.lit(True)), key, "left").write.parquet(paths[-1])
        marked = spark.read.parquet(paths[-1])
        ledger.append(marked.filter("known is null").select(*key))
    ledger.drop()
    return _read(spark, paths, "src_table string, k1 bigint, k2 int, load_no int, known boolean").filter("known").drop("known")


def repeats(rows: DataFrame) -> DataFrame:
    """(src_table, record_id) of rows whose key an earlier load brought. Repeated keys are unique per load,
    so AQE may split the rows of a hot one."""
    return rows.join(repeated_keys(rows), ["src_table", "k1", "k2", "load_no"]).select("src_table", F.col("id").alias("record_id"))


def near_classes(sets: DataFrame) -> DataFrame:
    """(cid, first): classes with a near duplicate of an earlier load and the earliest load of one.

    sets: (seed, cid, load_no, grams), partitioned by load_no on disk. Each load is probed, then appended.
    """
    spark = sets.sparkSession
    index: SegmentIndex | None = None
    paths: list[str] = []
    sizes = {r.load_no: r for r in sets.groupBy("load_no").agg(F.sum(F.size("grams")).alias("symbols"), F.count("*").alias("strings")).collect()}  # one entry each
    with ThreadPoolExecutor(1) as pool:  # segments of a load are appended while the next one's strings come in
        appended: Future | None = None
        for load in sorted(sizes):
            mine, size = sets.filter(F.col("load_no") == load), sizes[load]
            if index is None:
                index = SegmentIndex(mine, buckets_for(spark, size.symbols * 2 // 5))
            fresh = index.intake(mine, load)
            if appended:
                appended.result()
                paths.append(scratch(spark, "near-of-load"))
                index.probe(fresh, size.symbols).groupBy(F.col("b").alias("cid")).agg(F.min("load_a").alias("first")).write.parquet(paths[-1])
            appended = pool.submit(index.append, fresh, size.strings)
        if appended:
            appended.result()
    if index:
        index.drop()
    return _read(spark, paths, "cid bigint, first int")


def near_repeats(near: DataFrame, members: DataFrame) -> DataFrame:
    """Records of classes with a near duplicate in an earlier load than their own."""
    return members.join(near, "cid").filter("load_no > first").select("src_table", F.col("id").alias("record_id"))
