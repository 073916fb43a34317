"""Oracle SQL (DuckDB) of the training-data queries that SQL can express on the correctness scale."""

from __future__ import annotations

from lauda.llm import survivors
from lauda.sqltext import fold


def compact(c: str) -> str:
    return f"regexp_replace(lower(nfc_normalize(coalesce({c}, ''))), '[\\p{{P}}\\p{{Z}}\\p{{C}}\\s]+', '', 'g')"


def words(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"


_ALT = '\'[{"letter": "VARCHAR", "text": "VARCHAR"}]\''
RECORDS = f"""rec AS (
  SELECT 'questions' AS src_table, id, coalesce(load_no, 0) AS load_no, json_extract_string(payload_json, '$.statement') AS st, from_json(json_extract(payload_json, '$.alternatives'), {_ALT}) AS al
  FROM questions WHERE json_valid(payload_json)
  UNION ALL SELECT 'question_staging', id, 0, statement, CASE WHEN json_valid(alternatives) THEN from_json(alternatives, {_ALT}) END FROM question_staging
),
keyed AS (
  SELECT src_table, id, load_no, st, al, {compact('st')} || chr(2) || array_to_string(list_sort(list_distinct(list_transform(list_filter(coalesce(al, []), lambda a: {compact('a.text')} <> ''),
    lambda a: upper(regexp_replace(coalesce(a.letter, ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')) || chr(1) || {compact('a.text')}))), chr(3)) AS ckey FROM rec
)"""
COPIES = f"{RECORDS}, sets AS (SELECT src_table, ckey, min(id) AS keep_id, count(*) AS n, min(load_no) AS first FROM keyed GROUP BY 1, 2)"
PAIRS = f"""fields AS (SELECT src_table, id, {words('st')} AS w FROM keyed UNION ALL SELECT src_table, id, {words('t')} FROM (SELECT src_table, id, unnest(list_transform(coalesce(al, []), lambda a: a.text)) AS t FROM keyed)),
grams AS (SELECT DISTINCT src_table, id, g FROM (SELECT src_table, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM fields)),
sizes AS (SELECT src_table, id, count(*) AS n FROM grams GROUP BY 1, 2),
both_have AS (SELECT a.src_table, a.id AS id_a, b.id AS id_b, count(*) AS o FROM grams a JOIN grams b ON a.src_table = b.src_table AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
pairs AS (
  SELECT p.src_table, id_a, id_b, ka.load_no AS load_a, kb.load_no AS load_b FROM both_have p JOIN sizes x ON x.src_table = p.src_table AND x.id = id_a JOIN sizes y ON y.src_table = p.src_table AND y.id = id_b
  JOIN keyed ka ON ka.src_table = p.src_table AND ka.id = id_a JOIN keyed kb ON kb.src_table = p.src_table AND kb.id = id_b
  WHERE o * 8 >= 3 * (x.n + y.n) AND ka.ckey <> kb.ckey
)"""


def _digest(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '^\\s*sha-?256\\s*[:=]?', ''), '[^0-9a-f]', '', 'g')"


_DIGESTS = " UNION ALL ".join(
    f"SELECT '{t}' AS src_table, id, coalesce(load_no, 0) AS load_no, {_digest(c)} AS d FROM {t}" for t, c in (("import_batches", "content_sha256"), ("document_observations", "binary_sha256"), ("questions", "fingerprint"))
)
_STAND_INS = ", ".join(f"'{s}'" for s in survivors.STAND_INS)


def _value(f: str) -> str:
    v = f"json_extract_string(payload_json, '$.{f}')"
    ok = f"TRY_CAST({v} AS DOUBLE) BETWEEN 1900 AND 2100" if f == "year" else f"regexp_matches({v}, '[\\p{{L}}\\p{{N}}]') AND {fold(v)} NOT IN ({_STAND_INS})"
    return f"SELECT s.keep_id AS group_id, '{f}' AS field_name, q.id, q.status, q.confidence, q.updated_at FROM keyed k JOIN sets s ON s.src_table = k.src_table AND s.ckey = k.ckey JOIN questions q ON q.id = k.id WHERE k.src_table = 'questions' AND s.n > 1 AND coalesce({ok}, false)"


_RANK = "coalesce(list_position([" + ", ".join(f"'{s}'" for s in survivors.STATUS_ORDER) + "], lower(trim(status))), 99)"
ORACLE = {
    "p2_found": f"""
WITH {COPIES}, {PAIRS}, dig AS (SELECT * FROM ({_DIGESTS}) WHERE d <> ''), first AS (SELECT src_table, d, min(load_no) AS f FROM dig GROUP BY 1, 2)
SELECT src_table, id AS record_id FROM dig JOIN first USING (src_table, d) WHERE load_no > f
UNION SELECT k.src_table, id FROM keyed k JOIN sets s ON s.src_table = k.src_table AND s.ckey = k.ckey WHERE k.src_table = 'questions' AND load_no > first
UNION SELECT src_table, CASE WHEN load_a > load_b THEN id_a ELSE id_b END FROM pairs WHERE src_table = 'questions' AND load_a <> load_b""",
    "p4_found": f"WITH {COPIES}, {PAIRS} SELECT src_table, id_a, id_b FROM pairs",
    "p5_found": f"""
WITH {COPIES}, v AS ({' UNION ALL '.join(_value(f) for f in survivors.FIELDS)}),
r AS (SELECT group_id, field_name, id, row_number() OVER (PARTITION BY group_id, field_name ORDER BY {_RANK}, confidence DESC NULLS LAST, updated_at DESC NULLS LAST, id) AS rn FROM v)
SELECT group_id, field_name, id AS question_id FROM r WHERE rn = 1""",
    "p6_found": f"WITH {COPIES} SELECT k.src_table, keep_id, id AS copy_id FROM keyed k JOIN sets s ON s.src_table = k.src_table AND s.ckey = k.ckey WHERE id <> keep_id",
    "p6_copy_counts": f"WITH {COPIES} SELECT src_table, keep_id, n AS n_copies FROM sets",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {words('text')} AS w FROM documents), i AS (SELECT item_id, {words('text')} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM d),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
