"""State, ordering and batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.operators import state, windows
from lauda.session import materialize, table
from lauda.sources.sinks import latest_import, package_manifest


def _latest(df, key, order):
    return windows.latest_per_key(df, key, order)


def state_new_rows(spark, sf_dir):
    """Questions of the last load whose fingerprint no earlier load has."""
    q = table(spark, sf_dir, "questions").select("id", "fingerprint", "load_no")
    return state.new_rows(q.filter("load_no = 8"), q.filter("load_no < 8"), ["fingerprint"]).select("id", "fingerprint")


def state_insert_ignore(spark, sf_dir):
    """Digest registry after every load, in order: digests and the id that brought them first. Null loads count as load 0."""
    o = table(spark, sf_dir, "document_observations").select(F.lower(F.trim("binary_sha256")).alias("digest"), "id", F.coalesce("load_no", F.lit(0)).alias("load_no"))
    cur = o.select("digest", "id").limit(0)
    for n in sorted(r.load_no for r in o.select("load_no").distinct().collect()):  # one entry per load
        cur = materialize(state.insert_ignore(cur, o.filter(F.col("load_no") == n).select("digest", "id"), ["digest"]), "digests")
    return cur


def state_upsert(spark, sf_dir):
    """Suggestions per question after the redelivered rows were merged in."""
    s = table(spark, sf_dir, "desktop_answer_suggestions").select("id", "status", "ingested_at")
    last = _latest(s, ["id"], ["ingested_at", "status"])
    first = s.groupBy("id").agg(F.min(F.struct("ingested_at", "status")).alias("f")).select("id", "f.status", "f.ingested_at")
    return state.upsert(first, last, ["id"]).select("id", "status", "ingested_at")


def state_conditional_update(spark, sf_dir):
    """Statuses after marking approved questions with an official suggestion as exported."""
    q = table(spark, sf_dir, "questions").select("id", F.lower(F.trim("status")).alias("status"))
    hits = table(spark, sf_dir, "desktop_answer_suggestions").filter("is_official").select(F.trim(F.lower("question_id")).alias("id"))
    out = state.conditional_update(q, hits, ["id"], {"status": F.when(F.col("status") == "approved", "exported").otherwise(F.col("status"))})
    return out.groupBy("status").agg(F.count("*").alias("n"))


def state_one_active(spark, sf_dir):
    """Identities with more than one living version."""
    v = table(spark, sf_dir, "document_versions")
    return state.one_active_violations(v, ["identity_key"], F.col("deleted_at").isNull())


def state_retry_queue(spark, sf_dir):
    """Retry queue of all users after one round of outcomes: the last event is the outcome, earlier events other than purchases are the attempts (four at most)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    e = _latest(ev, ["user_id"], ["ts", "event_id"])
    earlier = ev.join(e.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti").filter("event_type <> 'purchase'")
    n = earlier.groupBy("user_id").agg(F.least(F.count("*"), F.lit(4)).cast("int").alias("attempts"))
    queue = n.select("user_id", "attempts", F.lit("waiting").alias("status"), F.lit(None).cast(e.schema["ts"].dataType).alias("next_at"))
    outcomes = e.select("user_id", (F.col("event_type") != "purchase").alias("failed"), F.col("ts").alias("at"))
    return state.retry_queue(queue, outcomes, "user_id", 5, 60)


def state_pending(spark, sf_dir):
    """Questions not processed, changed since, or processed by an older version."""
    q = table(spark, sf_dir, "questions").select("id", "updated_at", "exported_at")
    done = q.filter("exported_at is not null").select("id", F.col("exported_at").alias("processed_at"), F.when(F.col("id") < "8", "v2").otherwise("v1").alias("algorithm"))
    return state.pending(q.select("id", "updated_at"), done, ["id"], "updated_at", "v2").select("id")


def state_touched(spark, sf_dir):
    """Occurrences of the contests that the latest month touches."""
    o = table(spark, sf_dir, "question_occurrences").select("id", "contest_id", F.date_format("created_at", "yyyy-MM").alias("m")).filter("contest_id is not null")
    last = o.agg(F.max("m").alias("m"))
    return state.touched_boundaries(o, o.join(F.broadcast(last), "m", "left_semi"), ["contest_id"]).select("id", "contest_id").distinct()


def state_keep_last_good(spark, sf_dir):
    """Batches per model of the last load, earlier ones for models that brought nothing."""
    b = table(spark, sf_dir, "import_batches").filter("model is not null").select("id", "model", "load_no")
    return state.keep_last_good(b.filter("load_no < 8"), b.filter("load_no = 8"), "model").groupBy("model").agg(F.count("*").alias("n"), F.max("load_no").alias("load_no"))


def state_audit(spark, sf_dir):
    """Field changes between the first and the last delivery of suggestions."""
    s = table(spark, sf_dir, "desktop_answer_suggestions").select("id", "status", "confirmed_answer", "ingested_at")
    first = s.groupBy("id").agg(F.min(F.struct("ingested_at", "status", "confirmed_answer")).alias("f")).select("id", "f.*")
    return state.audit(first, _latest(s, ["id"], ["ingested_at"]), ["id"], ["ingested_at"]).groupBy("field_name").agg(F.count("*").alias("n"))


def state_latest_import(spark, sf_dir):
    """Latest batch per source, nulls last."""
    b = table(spark, sf_dir, "import_batches").select("source_sha256", "imported_at", "id", "model")
    return latest_import(b, "source_sha256", "imported_at", "id").select("source_sha256", "id", "model")


def state_package(spark, sf_dir):
    """Preview of an export package."""
    q = table(spark, sf_dir, "questions").select("id", F.lower(F.trim("status")).alias("status"))
    return package_manifest(q, F.col("status").isin("approved", "exported")).select("n_exported", "n_exceptions")


def order_batches(spark, sf_dir):
    """Pages of a document in review batches of four."""
    p = table(spark, sf_dir, "pages").select("document_id", "page_number")
    return windows.batches(p, ["page_number"], 4, ["document_id"]).groupBy("document_id", "batch_no").agg(F.count("*").alias("n"))


def order_quota(spark, sf_dir):
    """At most eight questions per document with two places kept for annulled ones."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null").select("id", "document_id", "question_number", F.get_json_object("payload_json", "$.answer_status").alias("s"))
    return windows.quota(q, ["document_id"], F.col("s") == "annulled", ["question_number", "id"], 8).select("id", "document_id")


def order_biggest(spark, sf_dir):
    """Most frequent board per discipline among staged questions."""
    s = table(spark, sf_dir, "question_staging").filter("board is not null and matter is not null").select("matter", "board")
    return windows.biggest_group(s, ["matter"], "board")


def order_first_per_key(spark, sf_dir):
    """First occurrence of every equivalence fingerprint."""
    o = table(spark, sf_dir, "question_occurrences").select("equivalence_fingerprint", "created_at", "id", "contest_id")
    return windows.first_per_key(o, ["equivalence_fingerprint"], ["created_at", "id"]).select("equivalence_fingerprint", "id", "contest_id")


def order_strata(spark, sf_dir):
    """One document per kind and language by seeded hash."""
    d = table(spark, sf_dir, "documents").select("doc_kind", F.coalesce("lang", F.lit("(none)")).alias("lang"), "doc_id")
    return windows.per_stratum(d, ["doc_kind", "lang"], "doc_id", "strata")


def _expected(spark, sf_dir):
    """Expected number range of each document: its first load's questions."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null and question_number is not null")
    first = q.groupBy("document_id").agg(F.min("load_no").alias("load_no"))
    return q.join(first, ["document_id", "load_no"]).groupBy("document_id").agg(F.min("question_number").alias("first"), F.max("question_number").alias("last"))


def state_number_exceptions(spark, sf_dir):
    """Missing, repeated and misplaced question numbers per document."""
    from lauda.operators.segments import number_exceptions

    q = table(spark, sf_dir, "questions").filter("document_id is not null").select("document_id", "question_number", F.struct("created_at", "id").alias("o"))
    return number_exceptions(q, _expected(spark, sf_dir), "document_id", "question_number", "o")


def state_segmentation(spark, sf_dir):
    from lauda.operators.segments import segmentation_metrics

    q = table(spark, sf_dir, "questions").filter("document_id is not null and question_number is not null").select("document_id", "question_number")
    return segmentation_metrics(q, _expected(spark, sf_dir), "document_id", "question_number")


def state_carry_forward(spark, sf_dir):
    """Decisions of earlier loads carried to later questions of the same fingerprint."""
    q = table(spark, sf_dir, "questions").select("id", "load_no", F.lower(F.trim("fingerprint")).alias("fp"), F.lower(F.trim("status")).alias("status"), "reviewer")
    old = q.filter("load_no < 4 and status in ('exported', 'approved', 'rejected')")
    return state.carry_forward(q.filter("load_no >= 4"), old, "fp", "status", []).groupBy("status", "carried").agg(F.count("*").alias("n"))


def state_invalidate(spark, sf_dir):
    """Statement groups that a deleted question sends back to review."""
    o = table(spark, sf_dir, "question_occurrences").select(F.col("statement_fingerprint").alias("g"), F.trim(F.lower("question_id")).alias("k")).filter("g is not null")
    gone = table(spark, sf_dir, "questions").filter("deleted_at is not null").select(F.col("id").alias("k"))
    groups = o.select("g").distinct().withColumn("status", F.lit("confirmed"))
    return state.invalidate(groups, o, gone, "g", "k").groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("state_", "order_")) and callable(v)}

ORACLE = {
    "state_new_rows": "SELECT id, fingerprint FROM questions q WHERE load_no = 8 AND NOT EXISTS (SELECT 1 FROM questions e WHERE e.load_no < 8 AND e.fingerprint = q.fingerprint)",
    "state_insert_ignore": """WITH o AS (SELECT lower(trim(binary_sha256)) AS digest, id, coalesce(load_no, 0) AS load_no, min(coalesce(load_no, 0)) OVER (PARTITION BY lower(trim(binary_sha256))) AS first FROM document_observations)
      SELECT digest, min(id) AS id FROM o WHERE load_no = first GROUP BY 1""",
    "state_upsert": "SELECT id, status, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, status DESC) AS rn FROM desktop_answer_suggestions) WHERE rn = 1",
    "state_conditional_update": """SELECT CASE WHEN lower(trim(status)) = 'approved' AND EXISTS (SELECT 1 FROM desktop_answer_suggestions s WHERE s.is_official AND trim(lower(s.question_id)) = q.id) THEN 'exported' ELSE lower(trim(status)) END AS status,
      count(*) AS n FROM questions q GROUP BY 1""",
    "state_one_active": "SELECT identity_key, count(*) AS n_active FROM document_versions WHERE deleted_at IS NULL GROUP BY 1 HAVING count(*) > 1",
    "state_retry_queue": """WITH e AS (SELECT user_id, event_type <> 'purchase' AS failed, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
      n AS (SELECT user_id, least(count(*), 4)::int AS a FROM e WHERE rn > 1 AND failed GROUP BY 1),
      j AS (SELECT e.user_id, coalesce(n.a, 0) + 1 AS k, ts FROM e LEFT JOIN n USING (user_id) WHERE rn = 1 AND failed)
      SELECT user_id, k::int AS attempts, CASE WHEN k >= 5 THEN 'exhausted' ELSE 'waiting' END AS status, CASE WHEN k < 5 THEN ts + to_seconds(60 * 2 ** (k - 1)) END AS next_at FROM j""",
    "state_pending": "SELECT id FROM questions WHERE exported_at IS NULL OR updated_at > exported_at OR NOT (id < '8')",
    "state_touched": """WITH o AS (SELECT id, contest_id, strftime(created_at, '%Y-%m') AS m FROM question_occurrences WHERE contest_id IS NOT NULL)
      SELECT DISTINCT id, contest_id FROM o WHERE contest_id IN (SELECT contest_id FROM o WHERE m = (SELECT max(m) FROM o))""",
    "state_keep_last_good": """WITH b AS (SELECT model, load_no FROM import_batches WHERE model IS NOT NULL AND load_no <= 8)
      SELECT model, count(*) AS n, max(load_no) AS load_no FROM b WHERE load_no = 8 OR model NOT IN (SELECT model FROM b WHERE load_no = 8) GROUP BY 1""",
    "state_audit": "SELECT 'ingested_at' AS field_name, count(*) AS n FROM (SELECT id FROM desktop_answer_suggestions GROUP BY id HAVING min(ingested_at) <> max(ingested_at)) HAVING count(*) > 0",
    "state_latest_import": "SELECT source_sha256, id, model FROM (SELECT *, row_number() OVER (PARTITION BY source_sha256 ORDER BY imported_at DESC NULLS LAST, id DESC) AS rn FROM import_batches) WHERE rn = 1",
    "state_package": "SELECT count(*) FILTER (lower(trim(status)) IN ('approved', 'exported')) AS n_exported, count(*) FILTER (lower(trim(status)) NOT IN ('approved', 'exported')) AS n_exceptions FROM questions",
    "order_batches": "WITH b AS (SELECT document_id, ((row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1) // 4)::int AS batch_no FROM pages) SELECT document_id, batch_no, count(*) AS n FROM b GROUP BY 1, 2",
    "order_quota": """WITH q AS (SELECT id, document_id, question_number, coalesce(CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.answer_status') END = 'annulled', false) AS k FROM questions WHERE document_id IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY document_id, k ORDER BY question_number, id) AS n FROM q) SELECT id, document_id FROM r WHERE n <= CASE WHEN k THEN 2 ELSE 6 END""",
    "order_biggest": "WITH g AS (SELECT matter, board, count(*) AS n FROM question_staging WHERE board IS NOT NULL AND matter IS NOT NULL GROUP BY 1, 2) SELECT matter, board, n FROM (SELECT *, row_number() OVER (PARTITION BY matter ORDER BY n DESC, board) AS rn FROM g) WHERE rn = 1",
    "order_first_per_key": "SELECT equivalence_fingerprint, id, contest_id FROM (SELECT *, row_number() OVER (PARTITION BY equivalence_fingerprint ORDER BY created_at, id) AS rn FROM question_occurrences) WHERE rn = 1",
    "order_strata": "SELECT doc_kind, lang, doc_id FROM (SELECT doc_kind, coalesce(lang, '(none)') AS lang, doc_id, row_number() OVER (PARTITION BY doc_kind, coalesce(lang, '(none)') ORDER BY sha256('strata' || doc_id::varchar), doc_id) AS rn FROM documents) WHERE rn = 1",
    "state_number_exceptions": """
WITH q AS (SELECT *, min(load_no) OVER (PARTITION BY document_id) AS f FROM questions WHERE document_id IS NOT NULL AND question_number IS NOT NULL),
e AS (SELECT document_id, min(question_number) AS a, max(question_number) AS b FROM q WHERE load_no = f GROUP BY 1),
w AS (SELECT document_id, unnest(range(a, b + 1))::int AS question_number FROM e),
l AS (SELECT document_id, question_number, lag(question_number) OVER (PARTITION BY document_id ORDER BY created_at, id) AS p FROM q)
SELECT document_id, question_number, 'missing' AS exception FROM w ANTI JOIN q USING (document_id, question_number)
UNION ALL SELECT document_id, question_number, 'duplicate' FROM q GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT q.document_id, q.question_number, 'out_of_range' FROM q JOIN e USING (document_id) WHERE q.question_number NOT BETWEEN e.a AND e.b
UNION ALL SELECT DISTINCT document_id, question_number, 'out_of_order' FROM l WHERE p > question_number""",
    "state_segmentation": """
WITH q AS (SELECT *, min(load_no) OVER (PARTITION BY document_id) AS f FROM questions WHERE document_id IS NOT NULL AND question_number IS NOT NULL),
e AS (SELECT document_id, min(question_number) AS a, max(question_number) AS b FROM q WHERE load_no = f GROUP BY 1),
h AS (SELECT DISTINCT q.document_id, q.question_number, q.question_number BETWEEN e.a AND e.b AS ok FROM q JOIN e USING (document_id)),
g AS (SELECT document_id, any_value(b - a + 1)::bigint AS n_expected, count(*) AS n_found, count(*) FILTER (ok) AS n_matched FROM h JOIN e USING (document_id) GROUP BY 1)
SELECT *, round(n_matched::double / n_found, 6) AS precision, round(n_matched::double / n_expected, 6) AS coverage FROM g""",
    "state_carry_forward": """
WITH q AS (SELECT id, load_no, lower(trim(fingerprint)) AS fp, lower(trim(status)) AS status FROM questions),
o AS (SELECT fp, min(d) AS d FROM (SELECT fp, CASE WHEN status = 'exported' THEN 'approved' ELSE status END AS d FROM q WHERE load_no < 4 AND status IN ('exported', 'approved', 'rejected')) GROUP BY 1 HAVING count(DISTINCT d) = 1)
SELECT coalesce(o.d, q.status) AS status, o.d IS NOT NULL AS carried, count(*) AS n FROM q LEFT JOIN o USING (fp) WHERE load_no >= 4 GROUP BY 1, 2""",
    "state_invalidate": """
WITH o AS (SELECT statement_fingerprint AS g, trim(lower(question_id)) AS k FROM question_occurrences WHERE statement_fingerprint IS NOT NULL),
h AS (SELECT g, bool_or(k IN (SELECT id FROM questions WHERE deleted_at IS NOT NULL)) AS hit FROM o GROUP BY 1)
SELECT CASE WHEN hit THEN 'needs_review' ELSE 'confirmed' END AS status, count(*) AS n FROM h GROUP BY 1""",
}
