"""Corpus pipeline as DataFrame stages with plug-in points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.functions import hashing, text
from lauda.operators import classify, dedup, parsers
from lauda.operators.state import StageTable


class Enricher(Protocol):
    """Adds suggestions to question rows. It may be a model behind mapInArrow; the default adds none."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


def no_enrichment(questions: DataFrame) -> DataFrame:
    return questions


def checked_suggestions(suggested: DataFrame, paths: DataFrame, floor: float) -> DataFrame:
    """Closed-choice check of suggestions (id, path, confidence): unknown paths and weak ones are
    refused with a code, never repaired."""
    j = suggested.join(paths.select("path", F.lit(True).alias("_known")).distinct(), "path", "left")
    code = F.when(F.col("path").isNull(), "no_choice").when(F.col("_known").isNull(), "unknown_path").when(~F.coalesce(F.col("confidence") >= floor, F.lit(False)), "low_confidence").otherwise("accepted")
    return j.select("id", "path", "confidence", code.alias("code"))


@dataclass
class Pipeline:
    """pages (document_id, page_number, text, name) to typed documents, questions and copies."""

    parse: Callable[[str], list[tuple]] = parsers.questions
    enrich: Enricher = no_enrichment
    stages: StageTable | None = None
    done: dict[str, DataFrame] = field(default_factory=dict)

    def documents(self, pages: DataFrame) -> DataFrame:
        """One row per document: ordered text, page hash, triage."""
        doc = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"), F.min("name").alias("name"))
        texts = F.transform("p", lambda x: F.coalesce(x["text"], F.lit("")))
        doc = doc.select("document_id", "name", F.array_join(texts, "\n\n").alias("text"), hashing.pages_fingerprint(texts).alias("fingerprint"))
        return doc.withColumn("triage", classify.triage(F.col("name"), F.col("text"))).select("*", "triage.decision", "triage.confidence").drop("triage")

    def questions(self, documents: DataFrame) -> DataFrame:
        """Questions of documents that aren't answer keys or administrative."""
        rows = parsers.expand(documents.filter("decision in ('exam', 'review')"), "document_id", "text", self.parse, parsers.QUESTION_SCHEMA)
        return self.enrich(rows.withColumn("statement_fingerprint", hashing.statement_fingerprint(F.col("statement"))))

    def distinct_questions(self, questions: DataFrame) -> DataFrame:
        """One row per statement and lettered alternatives: questions of one stem with other alternatives are no copies."""
        return dedup.keep_first(questions, F.struct("statement_fingerprint", "n_alternatives", text.fold(F.col("alternatives"))), "number")
