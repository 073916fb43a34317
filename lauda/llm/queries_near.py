"""Queries of problems 2 and 4: near duplicates, within tables and load after load."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.llm import canon, history, neardup
from lauda.session import materialize, table


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    feats, members = neardup.prepared(canon.both_tables(spark, sf_dir), "near")
    classes = materialize(neardup.class_pairs(feats).select("a", "b"), "near-classes")
    has_set = feats.filter(F.size("grams") > 0).select("cid").distinct()
    return neardup.unit_pairs(classes, members, has_set), members


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.record_pairs(*_units(spark, sf_dir))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record that has a near duplicate or shares its unit with one that has: the group's
    smallest id and the number of paired units in reach."""
    units, members = _units(spark, sf_dir)
    node = lambda c, k: F.xxhash64(c, k)
    edges = materialize(units.select(node("a", "key_a").alias("u"), node("b", "key_b").alias("v")), "near-edges")
    labels = neardup.components(edges)
    links = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    rows = members.select("src_table", "id", node("cid", "ckey").alias("node")).join(labels.join(links, "node"), "node")
    first = rows.groupBy("label").agg(F.min("id").alias("group_id"))
    return rows.join(first, "label").select("src_table", "id", "group_id", "n_links")


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
ORACLE: dict[str, str] = {}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats, members = neardup.prepared(canon.question_texts(table(spark, sf_dir, "questions")), "load", "load_no")
    strings = neardup.with_seed(feats).filter(F.size("grams") > 0)
    has_set = feats.filter(F.size("grams") > 0).select("cid").distinct()
    base = members.select("src_table", "id", "load_no", "cid", "ckey")
    copies = base.select("src_table", "id", "load_no", F.xxhash64(F.lit("copy"), "ckey").alias("k1"), F.hash("ckey", F.lit("copy")).alias("k2"))
    sets = base.join(has_set, "cid", "left_semi").select("src_table", "id", "load_no", F.col("cid").alias("k1"), F.lit(1).alias("k2"))
    keys = copies.unionByName(sets)
    for src, field in (("import_batches", "content_sha256"), ("document_observations", "binary_sha256"), ("questions", "fingerprint")):
        keys = keys.unionByName(history.digest_rows(table(spark, sf_dir, src), src, field))
    keys = materialize(keys, "load-keys", "load_no")
    with ThreadPoolExecutor(2) as pool:  # two states that don't know of one another
        near = pool.submit(history.near_classes, strings)
        same = history.repeats(keys)
        return same.unionByName(history.near_repeats(near.result(), members)).distinct()


def p2_repeats_per_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest repeats of batches and observations per load."""
    keys = [history.digest_rows(table(spark, sf_dir, s), s, f) for s, f in (("import_batches", "content_sha256"), ("document_observations", "binary_sha256"))]
    rows = materialize(keys[0].unionByName(keys[1]), "digest-keys", "load_no")
    found = history.repeats(rows).distinct().withColumnRenamed("record_id", "id")
    return rows.join(found, ["src_table", "id"], "left_semi").groupBy("src_table", "load_no").agg(F.countDistinct("id").alias("n_repeats"))


QUERIES |= {"p2_found": p2_found, "p2_repeats_per_load": p2_repeats_per_load}
_DIGEST = "regexp_replace(regexp_replace(lower({0}), '^\\s*sha-?256\\s*[:=]?', ''), '[^0-9a-f]', '', 'g')"
ORACLE["p2_repeats_per_load"] = f"""
WITH rows AS (
  SELECT 'import_batches' AS src_table, id, coalesce(load_no, 0) AS load_no, {_DIGEST.format("content_sha256")} AS key FROM import_batches
  UNION ALL SELECT 'document_observations', id, coalesce(load_no, 0), {_DIGEST.format("binary_sha256")} FROM document_observations
),
one AS (SELECT src_table, id, key, min(load_no) AS load_no FROM rows WHERE key <> '' AND id IS NOT NULL GROUP BY ALL),
first AS (SELECT src_table, key, min(load_no) AS first FROM one GROUP BY ALL),
found AS (SELECT DISTINCT one.src_table, one.id FROM one JOIN first USING (src_table, key) WHERE one.load_no > first.first)
SELECT src_table, load_no, count(DISTINCT id) AS n_repeats FROM one SEMI JOIN found USING (src_table, id) GROUP BY ALL"""
