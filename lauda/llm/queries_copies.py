"""Queries of problems 5 and 6: copies of questions and the record that survives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.llm import canon, survivors
from lauda.llm.ledger import Ledger, copies
from lauda.session import materialize, table


#: Keys of one ledger bucket, the unit that a task merges.
BUCKET_ROWS = 1_000_000


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, ledger): the ledger is built load after load, as the batches came in."""
    rows = materialize(canon.members(canon.features(canon.both_tables(spark, sf_dir))), "copy-members", "load_no")
    ledger = Ledger(spark, buckets=max(8, -(-rows.count() // BUCKET_ROWS)))
    for load in sorted(r.load_no for r in rows.select("load_no").distinct().collect()):  # one entry per load
        ledger.add(rows.filter(F.col("load_no") == load), load)
    return rows, ledger.read()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(*_ledger(spark, sf_dir))


def p6_copy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per question with its number of copies (itself included)."""
    return _ledger(spark, sf_dir)[1].select("src_table", "keep_id", F.col("copies").alias("n_copies"))


def _set_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sets of two or more copies in questions, with group_id and typed field values."""
    q = table(spark, sf_dir, "questions")
    texts = canon.question_texts(
        q,
        survivors.status_rank(F.col("status")).alias("rank"),
        "confidence",
        survivors.field_values(F.col("payload_json")).alias("vals"),
    )
    rows = materialize(canon.features(texts), "set-rows")
    sets = rows.groupBy("ckey", "id").agg(F.lit(1)).groupBy("ckey").agg(F.count("*").alias("n_rows"), F.min("id").alias("group_id"))
    return rows.join(sets.filter("n_rows > 1"), "ckey")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_set_rows(spark, sf_dir), "sets")
    fields = survivors.field_rows(rows)
    ranked = survivors.with_levels(fields, survivors.levels(survivors.precedence(rows)))
    groups = rows.select("ckey", "group_id").distinct()
    return survivors.best_rows(ranked).join(groups, "ckey").select("group_id", "field_name", "question_id")


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per set: each field from its best row, by currency where times are missing."""
    rows = materialize(_set_rows(spark, sf_dir), "sets")
    ranked = survivors.with_levels(survivors.field_rows(rows), survivors.levels(survivors.precedence(rows)))
    best = survivors.best_rows(ranked, currency_first=True).groupBy("ckey").agg(
        *[F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f) for f in survivors.FIELDS]
    )
    groups = rows.select("ckey", "group_id", "n_rows").distinct()
    return groups.join(best, "ckey", "left").select("group_id", "n_rows", *survivors.FIELDS)


def p5_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many learned value precedences each field has and how often they held."""
    learned = survivors.precedence(materialize(_set_rows(spark, sf_dir), "sets"))
    return learned.groupBy("field_name").agg(
        F.count("*").alias("n_precedences"), F.sum("n").alias("n_forward"), F.sum("n_back").alias("n_backward")
    )


def p5_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the topologically latest value is the last one where its times are hidden."""
    return survivors.currency_accuracy(materialize(_set_rows(spark, sf_dir), "sets"))


QUERIES = {
    "p5_currency": p5_currency,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p5_precedence": p5_precedence,
    "p6_found": p6_found,
    "p6_copy_counts": p6_copy_counts,
}
ORACLE: dict[str, str] = {}
