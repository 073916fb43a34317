"""Queries of problems 3, 7, 8 and 9 over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.llm import packing, scanfix, tiling, topics
from lauda.session import checked_broadcast, materialize, table

RUN_WORDS = 12
TILE_WORDS = 6


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which a tile is RUN_WORDS long: shorter seeds make the candidates, the tiling decides."""
    found = tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), TILE_WORDS, TILE_WORDS)
    return found.filter(F.col("longest") >= RUN_WORDS).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose tiles of six words or more cover at least 30 % of the item, in whatever order."""
    found = tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), TILE_WORDS, TILE_WORDS, (3, 10))
    return found.filter(F.col("covered") * 10 >= F.col("n_words") * 3).select(
        "doc_id", "item_id", "longest", "n_tiles", F.round(F.col("covered") / F.col("n_words"), 4).alias("coverage")
    )


def _area_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    areas = sorted(r.area_code for r in table(spark, sf_dir, "subject_areas").filter("area_code is not null").select("area_code").distinct().collect())
    return topics.area_counts(docs, topics.train(docs, table(spark, sf_dir, "doc_labels"), areas))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _area_counts(spark, sf_dir).filter("area_code is not null")
    return rows.filter(F.col("n_about") >= topics.SHARE * F.col("n_sentences")).select("doc_id", "area_code").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Make-up of the corpus: sentences per area (null: none), documents that touch it and that are about it."""
    rows = _area_counts(spark, sf_dir)
    about = F.col("n_about") >= topics.SHARE * F.col("n_sentences")
    return rows.groupBy("area_code").agg(
        F.sum("n_about").alias("n_sentences"), F.count("*").alias("n_docs_touching"), F.count_if(about & F.col("area_code").isNotNull()).alias("n_docs_about")
    )


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignment of all documents to containers of each capacity."""
    specs = table(spark, sf_dir, "packing_specs").filter("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()  # container kinds
    counts = materialize(packing.token_counts(table(spark, sf_dir, "documents")), "token-counts")
    all_ = counts.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.sum("n_prompt").alias("prompt")).first()
    share = packing.loss_share(all_.tokens or 0, all_.prompt or 0)
    buckets = max(1, -(-all_.n // packing.BUCKET_ITEMS))
    return packing.assignments(counts, [packing.Limits.of(r.spec_id, r.capacity_tokens, loss_share=share) for r in specs], buckets)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, documents, cut documents and fill per capacity."""
    spec = table(spark, sf_dir, "packing_specs").filter("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct()
    rows = p7_pack(spark, sf_dir)
    bins = rows.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("segments"))
    cut = rows.filter("piece_no = 1").groupBy("spec_id").agg(F.count("*").alias("n_cut"))
    out = bins.groupBy("spec_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_tokens"), F.max("segments").alias("most_segments"))
    return out.join(checked_broadcast(spec), "spec_id").join(cut, "spec_id", "left").select(
        "spec_id", "n_containers", "n_tokens", "most_tokens", "most_segments", F.coalesce("n_cut", F.lit(0)).alias("n_cut"),
        F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 4).alias("fill"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanfix.repair(table(spark, sf_dir, "pages"), table(spark, sf_dir, "question_staging"))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired text of every page and statement, in paragraphs."""
    return scanfix.repair(table(spark, sf_dir, "pages"), table(spark, sf_dir, "question_staging"), with_text=True)


QUERIES = {"p3_found": p3_found, "p3_text": p3_text, "p7_pack": p7_pack, "p7_fill": p7_fill, "p8_found": p8_found, "p8_coverage": p8_coverage, "p9_found": p9_found, "p9_composition": p9_composition}
ORACLE: dict[str, str] = {}
