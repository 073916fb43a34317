"""Near-duplicate records: pairs of records and their groups.

Records are compared by class (equal sets of word pairs) and unit (class and copy key); pairs of
units are expanded to records only at the end. Copies of one another are no pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.llm import canon, setjoin
from lauda.session import drop_path, materialize, scratch


def with_seed(feats: DataFrame) -> DataFrame:
    seed = F.when(F.col("src_table") == "questions", canon.SEEDS["questions"]).otherwise(canon.SEEDS["question_staging"])
    return feats.filter(F.col("grams").isNotNull()).select(seed.cast("bigint").alias("seed"), "cid", "load_no", "grams")


def class_pairs(feats: DataFrame, by_load: bool = False) -> DataFrame:
    """Verified pairs of classes over materialized features."""
    sets = with_seed(feats)
    sketch = setjoin.frequency_sketch(sets)
    found = setjoin.candidates(setjoin.postings(sets, sketch), by_load=by_load)
    return setjoin.verified(found, feats)


def unit_pairs(classes: DataFrame, members: DataFrame, has_set: DataFrame) -> DataFrame:
    """Pairs of units (class, copy key) from verified class pairs and from inside classes of several
    copy keys; the keys differ."""
    units = members.select("src_table", "cid", "ckey").distinct()
    a = units.withColumnsRenamed({"cid": "a", "ckey": "key_a"})
    b = units.drop("src_table").withColumnsRenamed({"cid": "b", "ckey": "key_b"})
    across = classes.select("a", "b").join(a, "a").join(b, "b").filter("key_a <> key_b")
    mixed = units.groupBy("cid").agg(F.count("*").alias("k")).filter("k > 1").join(has_set, "cid", "left_semi").select("cid")
    inside = (
        a.join(mixed.withColumnRenamed("cid", "a"), "a")
        .join(b.withColumn("a", F.col("b")), "a")
        .filter("key_a < key_b")
    )
    return across.select("src_table", "a", "key_a", "b", "key_b").unionByName(inside.select("src_table", "a", "key_a", "b", "key_b"))


def record_pairs(units: DataFrame, members: DataFrame) -> DataFrame:
    """(src_table, id_a, id_b), smaller id first, of all records of paired units."""
    m = members.select("cid", "ckey", "id")
    a = m.withColumnsRenamed({"cid": "a", "ckey": "key_a", "id": "x"})
    b = m.withColumnsRenamed({"cid": "b", "ckey": "key_b", "id": "y"})
    return units.join(a, ["a", "key_a"]).join(b, ["b", "key_b"]).select(
        "src_table", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the connected components of edges (u, v): alternating large and small stars.

    Each round is written to the shared folder; the loop ends at the fixed point, when no edge changes,
    which only a count brings to the driver. Labels only fall, so it is reached; the rounds grow with the
    logarithm of the longest path. Star centres keep their distinct neighbours in shuffled rows, never
    in one array.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    path = scratch(spark, "star")
    e.write.parquet(path)
    before = None
    while True:
        e = spark.read.parquet(path)
        sig = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sig == before:
            break
        before = sig
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))
        ).distinct()
        new = scratch(spark, "star")
        small.write.parquet(new)
        drop_path(spark, path)
        path = new
    e = spark.read.parquet(path)
    centre = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(centre).distinct()


def prepared(texts: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, members), both written once."""
    feats = materialize(canon.features(texts, grams=True), f"{name}-feats", partition_by)
    return feats, materialize(canon.members(feats), f"{name}-members")
