"""Pieces of oracle SQL (DuckDB) that mirror the engine's column functions."""

WS = r"[\s\x{00A0}\x{2000}-\x{200B}\x{3000}]+"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def fold_keep(c: str) -> str:
    return f"strip_accents(replace(lower({c}), 'ß', 'ss'))"


def fold(c: str) -> str:
    return squeeze(fold_keep(c))


def alnum(c: str) -> str:
    return f"trim(regexp_replace({fold_keep(c)}, '[^a-z0-9]+', ' ', 'g'))"


def wilson(k: str, n: str, low: bool) -> str:
    z = "1.959963984540054"
    centre = f"({k}::double/{n} + {z}*{z}/(2.0*{n}))"
    spread = f"({z}*sqrt(({k}::double/{n})*(1-{k}::double/{n})/{n} + {z}*{z}/(4.0*{n}*{n})))"
    v = f"({centre} {'-' if low else '+'} {spread})/(1+{z}*{z}/{n})"
    return f"round({'greatest' if low else 'least'}({v}, {'0.0' if low else '1.0'})*100, 3)"


def percent(a: str, b: str) -> str:
    return f"coalesce(round(CASE WHEN {b} = 0 THEN NULL ELSE {a}*100.0/{b} END, 3), 0.0)"


#: Typed questions: payloads that parse.
QUESTIONS = """q AS (
  SELECT id, document_id, question_number, fingerprint, status, confidence, created_at, updated_at, load_no, payload_json,
         json_extract_string(payload_json, '$.statement') AS statement, json_extract_string(payload_json, '$.matter') AS matter,
         json_extract_string(payload_json, '$.subject') AS subject, json_extract_string(payload_json, '$.discipline') AS discipline,
         json_extract_string(payload_json, '$.level') AS level, json_extract_string(payload_json, '$.difficulty') AS difficulty,
         json_extract_string(payload_json, '$.board') AS board, json_extract_string(payload_json, '$.organization') AS organization,
         json_extract_string(payload_json, '$.role') AS role, TRY_CAST(json_extract_string(payload_json, '$.year') AS INTEGER) AS year,
         json_extract_string(payload_json, '$.correct_answer') AS correct_answer, json_extract_string(payload_json, '$.answer_status') AS answer_status,
         json_extract_string(payload_json, '$.explanation') AS explanation,
         json_array_length(payload_json, '$.source_pages') AS n_pages, json_array_length(payload_json, '$.alternatives') AS n_alts,
         json_extract_string(payload_json, '$.alternatives[*].letter') AS letters, json_extract_string(payload_json, '$.alternatives[*].text') AS texts
  FROM questions WHERE json_valid(payload_json)
)"""
