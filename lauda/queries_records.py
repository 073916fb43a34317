"""Queries over question records: flags, validation, fingerprints, grouping, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions import hashing, text
from lauda.operators import dedup, facets, filters, quality, windows
from lauda.records import questions
from lauda.session import table
from lauda.sqltext import QUESTIONS, alnum, fold, fold_keep, squeeze


STATUSES = ("exported", "approved", "pending", "exception", "rejected")


def _status_rank(c):
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STATUSES)), F.lower(F.trim(c))), F.lit(0)), F.lit(99))


def question_flags(spark, sf_dir):
    """How often each quality flag is set."""
    return facets.element_histogram(questions(spark, sf_dir), quality.quality_flags(F.col("confidence"))).withColumnRenamed("value", "flag")


def question_errors(spark, sf_dir):
    """Transfer errors per question."""
    return questions(spark, sf_dir).select("id", F.array_join(quality.validation_errors(), ",").alias("errors")).filter("errors <> ''")


def question_gate(spark, sf_dir):
    """Gate state per status: origin and structure are critical, taxonomy and answer are not."""
    q = questions(spark, sf_dir)
    ok = lambda c: F.coalesce(c, F.lit(False))
    dims = {
        "origin": ok(F.size("source_pages") > 0),
        "structure": ok(F.size("alternatives").between(2, 5) & (F.length("statement") >= 10)),
        "answer": ok(F.col("answer_status") == "matched"),
        "taxonomy": ok(F.col("subject").isNotNull() & F.col("matter").isNotNull()),
    }
    return q.select(F.lower(F.trim("status")).alias("status"), quality.gate(dims, ["origin", "structure"]).alias("state")).groupBy("status", "state").agg(F.count("*").alias("n"))


def question_duplicate_numbers(spark, sf_dir):
    """Numbers that occur more than once in their document."""
    q = quality.with_duplicate_numbers(table(spark, sf_dir, "questions").select("id", "document_id", "question_number"), "document_id", "question_number")
    return q.filter("duplicate_number").select("id", "document_id", "question_number")


def occurrence_duplicate_numbers(spark, sf_dir):
    """Original numbers that occur more than once in their contest."""
    o = table(spark, sf_dir, "question_occurrences").filter("contest_id is not null and original_number is not null").select("id", "contest_id", "original_number").distinct()
    return quality.with_duplicate_numbers(o, "contest_id", "original_number").filter("duplicate_number").select("id", "contest_id", "original_number")


def question_diagnosis(spark, sf_dir):
    """Why questions lack an official answer: links counted from their occurrences."""
    occ = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "question_id", "answer_status", "answer_link_valid", "ingested_at"), ["id"], ["ingested_at"])
    per = occ.groupBy(F.trim(F.lower("question_id")).alias("id")).agg(F.count_if(F.coalesce("answer_link_valid", F.lit(False))).alias("n_links"), F.count("*").alias("n_occ"))
    q = questions(spark, sf_dir).join(per, "id", "left")
    n = F.coalesce("n_links", F.lit(0))
    d = quality.answer_diagnosis(
        F.coalesce(F.col("answer_status") == "matched", F.lit(False)) & (n > 0), F.coalesce(F.col("answer_status") == "annulled", F.lit(False)),
        F.col("n_occ").isNotNull(), n, F.col("correct_answer").isNotNull(), F.exists("alternatives", lambda a: a["letter"] == F.col("correct_answer")),
    )
    return q.select(d.alias("diagnosis")).groupBy("diagnosis").agg(F.count("*").alias("n"))


def question_fingerprints(spark, sf_dir):
    """Statement, exact and order-free identities of every question."""
    q = questions(spark, sf_dir)
    texts = F.transform("alternatives", lambda a: a["text"])
    return q.select("id", hashing.statement_fingerprint(F.col("statement")).alias("statement_fp"), hashing.exact_fingerprint(F.col("statement"), texts).alias("exact_fp"), hashing.invariant_fingerprint(F.col("statement"), texts).alias("invariant_fp"))


def question_statement_groups(spark, sf_dir):
    """Exact duplicates by statement text, with the representative of best status."""
    q = questions(spark, sf_dir).withColumn("fp", F.sha2(text.fold(F.col("statement")), 256)).withColumn("rank", _status_rank(F.col("status")))
    return windows.representative(q, ["fp"], [F.col("rank"), -F.coalesce("confidence", F.lit(-1.0)), F.col("id")], "id")


def question_within_document(spark, sf_dir):
    """One text per (document, number): the longest wins."""
    return dedup.within_document(questions(spark, sf_dir), "document_id", "question_number", "statement", "id").select("document_id", "question_number", F.length("statement").alias("n_chars"), "n_rows", "had_conflict")


def question_near_clusters(spark, sf_dir):
    """Clusters of questions with one statement and compatible alternatives, never two of one document."""
    q = questions(spark, sf_dir).select(
        "id", "discipline", F.col("document_id").alias("booklet"), text.comparison_key(text.question_text(F.col("statement"))).alias("skey"),
        F.transform("alternatives", lambda a: F.coalesce(a["text"], F.lit(""))).alias("alts"),
    )
    q = q.withColumn("ckey", F.sha2(F.array_join(F.array_sort(F.transform("alts", text.comparison_key)), "|"), 256)).withColumn("skey", F.sha2("skey", 256))
    units = dedup.exact_units(q, ["discipline"], "skey", "ckey", "booklet")
    return dedup.near_clusters(units, ["discipline"], "skey", "ckey")


def question_filter_report(spark, sf_dir):
    f = filters.FilterSet(level=["SUPERIOR", "médio"], year=[2015, 2016, 2017, 2018], min_confidence=0.5)
    return filters.filter_report(questions(spark, sf_dir), f)


def question_early_discard(spark, sf_dir):
    """Rows that no known value contradicts, against rows that fully match."""
    f = filters.FilterSet(level=["Superior"], board=["fundação narpau"])
    q = questions(spark, sf_dir)
    return q.agg(F.count_if(f.early_discard()).alias("n_possible"), F.count_if(f.predicate()).alias("n_matching"), F.count("*").alias("n_all"))


def question_alias_filter(spark, sf_dir):
    q = questions(spark, sf_dir)
    p = filters.contains_or_alias(F.col("organization"), "prefeitura", [["Prefeitura Municipal", "Autarquia Nibobaural"]])
    return q.filter(p).groupBy("organization").agg(F.count("*").alias("n"))


def question_merge_first(spark, sf_dir):
    """First value that isn't null per document and whether its questions differ."""
    q = questions(spark, sf_dir)
    return facets.merge_first(q, "document_id", [F.col("question_number"), F.col("id")], ["board", "level"])


def question_version_chain(spark, sf_dir):
    """Contents of each identity in order of first appearance with their predecessor."""
    v = table(spark, sf_dir, "document_versions").select("identity_key", "content_sha256", "created_at")
    return windows.version_chain(v, ["identity_key"], "content_sha256", "created_at").select("identity_key", "content_sha256", "version_no", "predecessor")


def version_chain_depth(spark, sf_dir):
    """Root and depth of every version by its predecessor references (pointer doubling)."""
    v = table(spark, sf_dir, "document_versions")
    k = lambda c: F.nullif(F.trim(F.lower(F.col(c))), F.lit(""))
    return dedup.chain_depth(v.select(k("id").alias("node"), k("predecessor_version_id").alias("predecessor")))


def version_heads(spark, sf_dir):
    v = table(spark, sf_dir, "document_versions")
    k = lambda c: F.nullif(F.trim(F.lower(F.col(c))), F.lit(""))
    return dedup.supersession_heads(v.select(k("id").alias("node"), k("predecessor_version_id").alias("predecessor")), v.select(k("id").alias("node")))


def occurrence_consensus(spark, sf_dir):
    """Answer consensus of the occurrences that share a statement, per contest."""
    o = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "statement_fingerprint", "answer_letter", "answer_status", "ingested_at"), ["id"], ["ingested_at"])
    return facets.consensus(o, ["statement_fingerprint"], F.col("answer_letter"), F.col("answer_status")).groupBy("group_status").agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"))


def occurrence_provenance(spark, sf_dir):
    o = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "equivalence_fingerprint", "contest_id", "booklet_id", "ingested_at"), ["id"], ["ingested_at"])
    return dedup.provenance(o, "equivalence_fingerprint", "id", ["contest_id", "booklet_id"])


def question_propagation(spark, sf_dir):
    """Levels filled from agreeing neighbours in their document."""
    q = questions(spark, sf_dir).select("id", "document_id", "question_number", "level", F.coalesce("confidence", F.lit(0.0)).alias("conf"))
    q = q.withColumn("ord", F.struct("question_number", "id"))
    return windows.propagate_between(q, ["document_id"], "ord", "level", "conf").filter("was_filled").select("id", "level_filled", "filled_confidence")


def question_order_check(spark, sf_dir):
    q = table(spark, sf_dir, "questions").select("document_id", "question_number", F.struct("created_at", "id").alias("o"))
    return windows.out_of_order(q, ["document_id"], "o", "question_number")


def question_mask(spark, sf_dir):
    from lauda.operators.sampling import assign_masks

    return assign_masks(questions(spark, sf_dir), "id", ["matter", "subject", "level"], "mask")


def question_public_view(spark, sf_dir):
    """Redacted projection: strings cut at 160 characters, lists at 32 entries."""
    q = questions(spark, sf_dir).select("id", "statement", "board", "source_pages")
    return filters.public_view(q, ["board"]).select("id", F.sha2("statement", 256).alias("statement_sha"), F.size("source_pages").alias("n_pages"))


def question_scope_ids(spark, sf_dir):
    """An operation scope given by a filter."""
    return filters.Scope(filters=filters.FilterSet(level=["fundamental"], search="conforme")).apply(questions(spark, sf_dir)).select("id", "level")


QUERIES = {k: v for k, v in globals().items() if k.startswith(("question_", "version_", "occurrence_")) and callable(v)}

_LETTERS = "array_to_string(letters, '')"
_OK_LETTERS = f"({_LETTERS} = substring('ABCDEFGH', 1, n_alts::int))"
_ALLTEXT = fold("concat_ws(' ', statement, array_to_string(texts, ' '))")
_O = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM question_occurrences) WHERE rn = 1)"
_KEY = "nullif(trim(lower({0})), '')"
_IN_LETTERS = "list_contains(letters, correct_answer)"



def _qtext(c):
    lines = f"list_transform(string_split(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: {squeeze('x')})"
    kept = f"list_filter({lines}, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(concurso p[uú]blico.*|.*\\btipo [1-9][0-9]* ?[-–—]? ?p[aá]gina [0-9]+)$'))"
    return f"regexp_replace(lower(array_to_string({kept}, ' ')), '^\\s*(?:quest(?:ão|ao)|q\\.?)[-_ ]*[0-9]+\\s*[).:-]?\\s*', '')"


ORACLE = {
    "question_flags": f"""
WITH {QUESTIONS}, f AS (SELECT list_filter([
  CASE WHEN coalesce(length(trim(coalesce(statement, ''))) < 10 OR coalesce(n_pages, 0) < 1 OR n_alts NOT BETWEEN 2 AND 5 OR NOT {_OK_LETTERS} OR (correct_answer IS NOT NULL AND NOT {_IN_LETTERS}), true) THEN 'incomplete' END,
  CASE WHEN trim(coalesce(explanation, '')) = '' THEN 'without_explanation' END, CASE WHEN answer_status = 'annulled' THEN 'annulled' END, CASE WHEN answer_status = 'missing' THEN 'without_answer' END,
  CASE WHEN {' OR '.join(f"contains({_ALLTEXT}, '{m}')" for m in quality.VISUAL)} THEN 'visual' END,
  CASE WHEN year IS NULL OR {' OR '.join(f"coalesce({c}, '') = ''" for c in ('discipline', 'matter', 'subject', 'board', 'role', 'organization', 'level'))} THEN 'missing_fields' END,
  CASE WHEN confidence IS NULL OR confidence < 0.65 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS flags FROM q)
SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY flag""",
    "question_errors": f"""
WITH {QUESTIONS}, e AS (SELECT id, array_to_string(list_filter([
  {', '.join(f"CASE WHEN coalesce(length(trim({c})), 0) < 2 THEN '{c}_required' END" for c in ('board', 'organization', 'role', 'level'))},
  CASE WHEN coalesce(length(trim(statement)), 0) < 10 THEN 'statement_too_short' END, CASE WHEN year IS NULL THEN 'year_required' END, CASE WHEN coalesce(n_pages, 0) < 1 THEN 'page_required' END,
  CASE WHEN coalesce(answer_status, '') <> 'matched' OR correct_answer IS NULL THEN 'answer_required' END,
  CASE WHEN n_alts NOT BETWEEN 2 AND 5 THEN 'alternative_count' WHEN NOT {_OK_LETTERS} THEN 'alternative_order' END,
  CASE WHEN correct_answer IS NOT NULL AND NOT {_IN_LETTERS} THEN 'answer_not_among_alternatives' END], lambda x: x IS NOT NULL), ',') AS errors FROM q)
SELECT id, errors FROM e WHERE errors <> ''""",
    "question_gate": f"""
WITH {QUESTIONS}
SELECT lower(trim(status)) AS status, CASE WHEN NOT (coalesce(n_pages > 0, false) AND coalesce(n_alts BETWEEN 2 AND 5 AND length(statement) >= 10, false)) THEN 'quarantined'
  WHEN NOT (coalesce(answer_status = 'matched', false) AND subject IS NOT NULL AND matter IS NOT NULL) THEN 'needs_review' ELSE 'auto_ready' END AS state, count(*) AS n FROM q GROUP BY ALL""",
    "occurrence_duplicate_numbers": "SELECT id, contest_id, original_number FROM (SELECT *, count(*) OVER (PARTITION BY contest_id, original_number) AS c FROM (SELECT DISTINCT id, contest_id, original_number FROM question_occurrences WHERE contest_id IS NOT NULL AND original_number IS NOT NULL)) WHERE c > 1",
    "question_duplicate_numbers": "SELECT id, document_id, question_number FROM (SELECT *, count(*) OVER (PARTITION BY document_id, question_number) AS c FROM questions WHERE document_id IS NOT NULL AND question_number IS NOT NULL) WHERE c > 1",
    "question_diagnosis": f"""
WITH {QUESTIONS}, per AS (SELECT trim(lower(question_id)) AS id, count(*) FILTER (coalesce(answer_link_valid, false)) AS n_links, count(*) AS n_occ FROM {_O} GROUP BY 1),
j AS (SELECT q.*, coalesce(per.n_links, 0) AS n, per.n_occ FROM q LEFT JOIN per USING (id))
SELECT CASE WHEN coalesce(answer_status = 'matched', false) AND n > 0 THEN 'official' WHEN coalesce(answer_status = 'annulled', false) THEN 'annulled' WHEN n_occ IS NULL THEN 'no_key_document'
  WHEN n = 0 THEN 'key_not_linked' WHEN n > 1 THEN 'ambiguous_key' WHEN correct_answer IS NULL THEN 'number_not_in_key' WHEN NOT {_IN_LETTERS} THEN 'letter_not_among_alternatives' ELSE 'unresolved' END AS diagnosis, count(*) AS n
FROM j GROUP BY 1""",
    "question_statement_groups": f"""
WITH {QUESTIONS}, r AS (SELECT sha256({fold('statement')}) AS fp, id, coalesce(list_position(['exported', 'approved', 'pending', 'exception', 'rejected'], lower(trim(status))), 99) AS rank, coalesce(confidence, -1.0) AS c FROM q)
SELECT fp, count(*) AS n_rows, arg_min(id, (rank, -c, id)) AS representative FROM r GROUP BY fp""",
    "question_within_document": f"""
WITH {QUESTIONS}
SELECT document_id, question_number, max(length(statement)) AS n_chars, count(*) AS n_rows, count(DISTINCT statement) > 1 AS had_conflict FROM q GROUP BY 1, 2""",
    "question_filter_report": f"""
WITH {QUESTIONS}, p AS (SELECT coalesce({fold('level')} IN ('superior', 'medio'), false) AND coalesce(year IN (2015, 2016, 2017, 2018), false) AND coalesce(confidence >= 0.5, false) AS ok FROM q)
SELECT count(*) FILTER (ok) AS n_accepted, count(*) FILTER (NOT ok) AS n_rejected FROM p""",
    "question_early_discard": f"""
WITH {QUESTIONS}, p AS (SELECT (level IS NULL OR {fold('level')} = 'superior') AND (board IS NULL OR {fold('board')} = 'fundacao narpau') AS possible,
  coalesce({fold('level')} = 'superior', false) AND coalesce({fold('board')} = 'fundacao narpau', false) AS ok FROM q)
SELECT count(*) FILTER (possible) AS n_possible, count(*) FILTER (ok) AS n_matching, count(*) AS n_all FROM p""",
    "question_alias_filter": f"""
WITH {QUESTIONS} SELECT organization, count(*) AS n FROM q WHERE contains({fold('organization')}, 'prefeitura') OR {fold('organization')} IN ('prefeitura municipal', 'autarquia nibobaural') GROUP BY 1""",
    "question_merge_first": f"""
WITH {QUESTIONS}
SELECT document_id, count(*) AS n_rows, arg_min(board, (question_number, id)) FILTER (board IS NOT NULL) AS board, arg_min(level, (question_number, id)) FILTER (level IS NOT NULL) AS level,
  count(DISTINCT {fold('board')}) > 1 AS board_differs, count(DISTINCT {fold('level')}) > 1 AS level_differs FROM q GROUP BY 1""",
    "question_version_chain": """
WITH f AS (SELECT identity_key, content_sha256, min(created_at) AS first_at FROM document_versions GROUP BY 1, 2)
SELECT identity_key, content_sha256, row_number() OVER w AS version_no, lag(content_sha256) OVER w AS predecessor FROM f WINDOW w AS (PARTITION BY identity_key ORDER BY first_at, content_sha256)""",
    "version_chain_depth": f"""
WITH RECURSIVE e AS (SELECT {_KEY.format('id')} AS node, {_KEY.format('predecessor_version_id')} AS up FROM document_versions),
r AS (SELECT node, node AS cur, up, 0 AS depth FROM e UNION ALL SELECT r.node, e.node, e.up, r.depth + 1 FROM r JOIN e ON r.up = e.node WHERE r.depth < 200),
fin AS (SELECT node, cur AS root, depth FROM r WHERE up IS NULL)
SELECT e.node, fin.root, fin.depth FROM e LEFT JOIN fin USING (node)""",
    "version_heads": f"SELECT {_KEY.format('id')} AS node FROM document_versions v WHERE NOT EXISTS (SELECT 1 FROM document_versions p WHERE {_KEY.format('p.predecessor_version_id')} = {_KEY.format('v.id')})",
    "occurrence_consensus": f"""
WITH g AS (SELECT statement_fingerprint, count(*) AS n_rows, count(DISTINCT answer_letter) AS k, count(*) FILTER (answer_status = 'missing') AS m FROM {_O} GROUP BY 1)
SELECT CASE WHEN k > 1 THEN 'conflict' WHEN m > 0 THEN 'incomplete' WHEN k = 1 THEN 'confirmed' ELSE 'needs_review' END AS group_status, count(*) AS n_groups, sum(n_rows)::bigint AS n_rows FROM g GROUP BY 1""",
    "occurrence_provenance": f"""
SELECT equivalence_fingerprint, count(*) AS n_provenances, count(DISTINCT CASE WHEN contest_id IS NOT NULL AND booklet_id IS NOT NULL THEN (contest_id, booklet_id) END) AS n_distinct,
  arg_min_null(contest_id, id) AS first_contest_id, arg_min_null(booklet_id, id) AS first_booklet_id FROM {_O} GROUP BY 1""",
    "question_propagation": f"""
WITH {QUESTIONS}, n AS (SELECT id, level, lag(level) OVER w AS b, lead(level) OVER w AS a, lag(coalesce(confidence, 0.0)) OVER w AS cb, lead(coalesce(confidence, 0.0)) OVER w AS ca
  FROM q WINDOW w AS (PARTITION BY document_id ORDER BY question_number NULLS FIRST, id))
SELECT id, b AS level_filled, 0.78::double AS filled_confidence FROM n WHERE level IS NULL AND b = a AND cb >= 0.8 AND ca >= 0.8""",
    "question_order_check": """
WITH l AS (SELECT document_id, coalesce(lag(question_number) OVER (PARTITION BY document_id ORDER BY created_at, id) >= question_number, false) AS bad FROM questions)
SELECT document_id, bool_or(bad) AS out_of_order, count(*) AS n_rows FROM l GROUP BY 1""",
    "question_public_view": f"""
WITH {QUESTIONS} SELECT id, sha256(CASE WHEN length(statement) > 160 THEN substring(statement, 1, 160) || '…' ELSE statement END) AS statement_sha, least(n_pages, 32)::int AS n_pages FROM q""",
    "question_scope_ids": f"WITH {QUESTIONS} SELECT id, level FROM q WHERE {fold('level')} = 'fundamental' AND contains({fold('statement')}, 'conforme')",
    "question_fingerprints": f"""
WITH {QUESTIONS}, t AS (SELECT id, {_qtext('statement')} AS st, list_transform(texts, lambda x: regexp_replace(lower({squeeze('x')}), '^\\s*[a-h]\\s*[).:-]\\s*', '')) AS alts FROM q)
SELECT id, sha256(regexp_replace({fold_keep('st')}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS statement_fp,
  sha256('{{"alternatives":' || to_json(alts)::varchar || ',"statement":' || to_json(st)::varchar || '}}') AS exact_fp,
  sha256('{{"alternatives":' || to_json(list_sort(alts))::varchar || ',"statement":' || to_json(st)::varchar || '}}') AS invariant_fp FROM t""",
    "question_mask": f"""
WITH {QUESTIONS}, k AS (SELECT id, list_filter([CASE WHEN matter IS NOT NULL THEN 'matter' END, CASE WHEN subject IS NOT NULL THEN 'subject' END, CASE WHEN level IS NOT NULL THEN 'level' END], lambda x: x IS NOT NULL) AS known,
  ('0x' || substring(sha256('mask' || id), 1, 8))::bigint AS h FROM q)
SELECT id, CASE WHEN len(known) > 0 THEN known[(h % len(known)) + 1] END AS masked_field FROM k""",
}
