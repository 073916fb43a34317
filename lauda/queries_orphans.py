"""Queries of problem 1 and their oracle SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lauda.operators import orphans as o
from lauda.session import table

REFERENCES = (
    (o.Reference("question_occurrences", "document_version_id", "version", "ingested_at"), "question_occurrences"),
    (o.Reference("document_versions", "predecessor_version_id", "version", "updated_at"), "document_versions"),
    (o.Reference("desktop_answer_suggestions", "question_id", "question", "ingested_at"), "desktop_answer_suggestions"),
)
TARGETS = (("document_versions", "version"), ("questions", "question"))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [o.references(table(spark, sf_dir, t), r) for r, t in REFERENCES])


def _followed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, o.OrphanState]:
    """(suspects, state) after all change deltas, year by year."""
    given_up = reduce(DataFrame.unionByName, [o.superseded(table(spark, sf_dir, t), r) for r, t in REFERENCES])
    targets = reduce(DataFrame.unionByName, [o.target_deltas(table(spark, sf_dir, t), s) for t, s in TARGETS])
    return o.follow(_refs(spark, sf_dir), given_up, targets)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    suspects, state = _followed(spark, sf_dir)
    return o.orphan_records(suspects, state.current(suspects.select(*o.OrphanState.KEY).distinct()))


def p1_orphans_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.orphans_per_period(p1_found(spark, sf_dir))


def p1_orphan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return o.orphan_keys(_followed(spark, sf_dir)[1].current())


QUERIES = {"p1_found": p1_found, "p1_orphans_per_period": p1_orphans_per_period, "p1_orphan_keys": p1_orphan_keys}

_REFS = r"""
refs AS (
  SELECT 'question_occurrences' AS ref_table, id AS record_id, 'version' AS space, document_version_id AS raw, created_at AS moment
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM question_occurrences) WHERE rn = 1
  UNION ALL SELECT 'document_versions', id, 'version', predecessor_version_id, created_at FROM document_versions
  UNION ALL SELECT 'desktop_answer_suggestions', id, 'question', question_id, created_at
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM desktop_answer_suggestions) WHERE rn = 1
),
r AS (SELECT ref_table, record_id, space, lower(regexp_replace(raw, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS key, moment FROM refs WHERE regexp_replace(raw, '[\s\x{00A0}]+', '', 'g') <> ''),
targets AS (
  SELECT space, key, min(created_at) AS born, CASE WHEN count(*) = count(deleted_at) THEN max(deleted_at) END AS gone
  FROM (SELECT 'version' AS space, lower(trim(id)) AS key, created_at, deleted_at FROM document_versions
        UNION ALL SELECT 'question', lower(trim(id)), created_at, deleted_at FROM questions)
  GROUP BY space, key
)"""
_FOUND = f"""
WITH {_REFS},
found AS (
  SELECT ref_table, record_id,
         CASE WHEN t.key IS NULL THEN 'missing' WHEN t.born > r.moment THEN 'late' WHEN t.gone <= r.moment THEN 'deleted' END AS reason,
         strftime(r.moment, '%Y-%m') AS ref_period
  FROM r LEFT JOIN targets t ON r.space = t.space AND r.key = t.key
)"""

ORACLE = {
    "p1_found": f"{_FOUND} SELECT ref_table, record_id, reason, ref_period FROM found WHERE reason IS NOT NULL",
    "p1_orphans_per_period": f"{_FOUND} SELECT ref_table, ref_period, reason, count(*) AS n_records FROM found WHERE reason IS NOT NULL GROUP BY ALL",
    "p1_orphan_keys": f"""
WITH {_REFS},
alive AS (SELECT space, key FROM targets WHERE gone IS NULL),
known AS (SELECT space, key FROM targets)
SELECT r.space AS key_space, r.key AS ref_key, count(*) AS n_refs,
       CASE WHEN max(k.key) IS NULL THEN 'missing' ELSE 'deleted' END AS reason
FROM r LEFT JOIN known k ON r.space = k.space AND r.key = k.key
WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.space = r.space AND a.key = r.key)
GROUP BY r.space, r.key""",
}
