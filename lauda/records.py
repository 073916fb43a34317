"""Typed views of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.session import table

PAYLOAD = (
    "number int, statement string, alternatives array<struct<letter:string,text:string>>, matter string, subject string, discipline string, level string, "
    "difficulty string, board string, organization string, role string, year int, source_pages array<int>, correct_answer string, answer_status string, explanation string"
)


def questions(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Questions whose payload parses, with typed payload columns: JSON is decoded once."""
    q = table(spark, sf_dir, "questions").filter(F.try_parse_json("payload_json").isNotNull())
    return q.select("id", "document_id", "question_number", "fingerprint", "status", "confidence", "created_at", "updated_at", "load_no", *extra, F.from_json("payload_json", PAYLOAD).alias("p")).select(
        "id", "document_id", "question_number", "fingerprint", "status", "confidence", "created_at", "updated_at", "load_no", *extra, "p.*"
    )
