"""Counting queries: facets, reports, multi-dimension counters, event and order aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lauda.functions import stats
from lauda.operators import facets, filters, sampling, windows
from lauda.records import questions
from lauda.session import table
from lauda.sqltext import QUESTIONS, fold, percent, wilson



def count_facets(spark, sf_dir):
    """Facets of questions under all filters but the facet's own."""
    q = questions(spark, sf_dir).withColumn("state", F.lower(F.trim("status")))
    return facets.skip_one_facets(
        q,
        {"level": F.col("level"), "difficulty": F.col("difficulty"), "state": F.col("state"), "year": F.col("year")},
        {"level": F.col("level") == "Superior", "difficulty": F.col("difficulty").isin("Fácil", "Média"), "state": F.col("state").isin("approved", "exported")},
    )


def count_facet_ranks(spark, sf_dir):
    return facets.facet_order(count_facets(spark, sf_dir)).filter("rank <= 3").select("facet", "value", "n", "rank")


def count_dimensions(spark, sf_dir):
    q = questions(spark, sf_dir)
    return facets.multi_counts(q, {"level": F.col("level"), "difficulty": F.col("difficulty"), "year": F.col("year"), "discipline": F.col("discipline"), "answer": F.col("answer_status")})


def count_group_report(spark, sf_dir):
    q = questions(spark, sf_dir)
    s = F.lower(F.trim("status"))
    return facets.group_report(q, F.col("role"), {"exported": s == "exported", "rejected": s == "rejected", "annulled": F.col("answer_status") == "annulled"})


def count_completeness(spark, sf_dir):
    return facets.completeness(questions(spark, sf_dir), ["matter", "subject", "level", "difficulty", "board", "organization", "role", "year", "explanation"])


def count_status(spark, sf_dir):
    return facets.status_histogram(table(spark, sf_dir, "questions"), F.lower(F.trim("status")), ["exported", "approved", "pending", "exception", "rejected", "withdrawn"])


def count_flags(spark, sf_dir):
    q = table(spark, sf_dir, "questions").select(F.from_json("flags_json", "array<string>").alias("flags"))
    return facets.element_histogram(q, F.col("flags"))


def count_top_groups(spark, sf_dir):
    """Thirty most frequent unresolved combinations."""
    q = questions(spark, sf_dir).filter("subject is null or subject = ''")
    return facets.top_groups(q, ["board", "level", "year"], 30)


def count_suggestions(spark, sf_dir):
    """Independent counts of two tables in one row."""
    s = table(spark, sf_dir, "desktop_answer_suggestions")
    q = table(spark, sf_dir, "questions")
    return facets.one_row(
        s.agg(F.count("*").alias("n_suggestions"), F.count_distinct("question_id").alias("n_questions"), F.count_if(F.coalesce("is_official", F.lit(False))).alias("n_official")),
        q.agg(F.count("*").alias("n_stored"), F.count_if(F.col("deleted_at").isNotNull()).alias("n_deleted")),
    )


def count_tables(spark, sf_dir):
    names = ["questions", "question_staging", "question_occurrences", "document_versions", "document_observations", "pages", "import_batches", "desktop_answer_suggestions"]
    out = None
    for n in names:
        one = table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def count_contexts(spark, sf_dir):
    """Confirmed and distinct occurrences per role and shift, nulls labelled."""
    o = table(spark, sf_dir, "question_occurrences")
    return o.groupBy(F.coalesce("role_id", F.lit("(none)")).alias("role"), F.coalesce("shift_id", F.lit("(none)")).alias("shift")).agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("answer_status") == "matched", F.col("question_id"))).alias("n_matched_questions"), F.count_distinct("booklet_id").alias("n_booklets")
    )


def count_document_rollup(spark, sf_dir):
    q = questions(spark, sf_dir)
    return facets.document_rollup(q, "document_id", F.coalesce(F.col("answer_status") == "matched", F.lit(False)), F.coalesce("answer_status", F.lit("unknown")))


def count_ordered_values(spark, sf_dir):
    """Levels of each document in order of first appearance."""
    q = questions(spark, sf_dir).filter("level is not null").withColumn("ord", F.struct("question_number", "id"))
    return facets.ordered_distinct(q, "document_id", "ord", "level")


def count_field_ratio(spark, sf_dir):
    """Accepted precision, coverage and review rate of suggestions by model."""
    s = table(spark, sf_dir, "desktop_answer_suggestions")
    return sampling.acceptance(s, ["model"], F.coalesce(F.col("confidence") >= 0.7, F.lit(False)), F.coalesce(F.col("suggested_answer") == F.col("confirmed_answer"), F.lit(False)))


def count_model_accuracy(spark, sf_dir):
    s = table(spark, sf_dir, "desktop_answer_suggestions").filter("confirmed_answer is not null")
    return sampling.accuracy_table(s, ["model", "provider"], F.col("suggested_answer") == F.col("confirmed_answer"))


def count_coverage(spark, sf_dir):
    """Share of documents' observations that were resolved to a version, per status."""
    o = table(spark, sf_dir, "document_observations")
    return facets.coverage(o, ["resolution_status"], F.col("document_version_id").isNotNull())


def event_summary(spark, sf_dir):
    return facets.latency_table(table(spark, sf_dir, "events"), ["event_type"], F.col("value"))


def event_props(spark, sf_dir):
    """JSON path predicate and typed decode of event properties."""
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.filter("k >= 50").groupBy("event_type").agg(F.count("*").alias("n"), F.max("k").alias("k_max"))


def event_hourly(spark, sf_dir):
    """Tumbling windows of an hour: batch form of the streaming telemetry."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def event_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return windows.latest_per_key(e, ["user_id"], ["ts", "event_id"])


def event_recent(spark, sf_dir):
    return windows.recent(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "ts", "event_id", 25)


def event_sessions(spark, sf_dir):
    """Sessions per user: a gap of over thirty minutes starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.coalesce((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 1800 * 10**6).cast("int"), F.lit(1)).alias("s"))
    return e.groupBy("user_id").agg(F.sum("s").alias("n_sessions"), F.count("*").alias("n_events"))


def order_status_priority(spark, sf_dir):
    """Orders and value by two dimensions with subtotals."""
    o = table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("total")).withColumn("g", F.lit(1)).drop("g")


def line_consensus(spark, sf_dir):
    return facets.consensus(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", F.lit("missing")))


def line_conditional_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct(F.when(F.col("l_discount") > 0.05, F.col("l_suppkey"))).alias("n_suppliers"),
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(24,4)")).cast("double").alias("revenue"),
    )


def allocation_by_area(spark, sf_dir):
    """A hundred seats over the areas by largest remainder."""
    n = table(spark, sf_dir, "doc_labels").groupBy("area_code").agg(F.count("*").alias("n_docs"))
    return stats.largest_remainder(n, "area_code", "n_docs", 100)


QUERIES = {k: v for k, v in globals().items() if k.startswith(("count_", "event_", "order_", "line_", "allocation_")) and callable(v)}

_F = """f AS (SELECT level, difficulty, lower(trim(status)) AS state, year, coalesce(level = 'Superior', false) AS p1, coalesce(difficulty IN ('Fácil', 'Média'), false) AS p2, coalesce(lower(trim(status)) IN ('approved', 'exported'), false) AS p3 FROM q),
u AS (SELECT 'level' AS facet, level AS value, p1 AS sel FROM f WHERE p2 AND p3 UNION ALL SELECT 'difficulty', difficulty, p2 FROM f WHERE p1 AND p3
  UNION ALL SELECT 'state', state, p3 FROM f WHERE p1 AND p2 UNION ALL SELECT 'year', year::varchar, false FROM f WHERE p1 AND p2 AND p3),
fac AS (SELECT facet, value, count(*) AS n, bool_or(sel) AS selected FROM u WHERE value IS NOT NULL GROUP BY 1, 2)"""
_FIELDS = ["matter", "subject", "level", "difficulty", "board", "organization", "role", "year", "explanation"]
_DIMS = {"level": "level", "difficulty": "difficulty", "year": "year::varchar", "discipline": "discipline", "answer": "answer_status"}
_TABLES = ["questions", "question_staging", "question_occurrences", "document_versions", "document_observations", "pages", "import_batches", "desktop_answer_suggestions"]

ORACLE = {
    "count_facets": f"WITH {QUESTIONS}, {_F} SELECT * FROM fac",
    "count_facet_ranks": f"WITH {QUESTIONS}, {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, {fold('value')}, value) AS rank FROM fac) SELECT facet, value, n, rank FROM r WHERE rank <= 3",
    "count_dimensions": f"WITH {QUESTIONS} " + " UNION ALL ".join(f"SELECT '{n}' AS dimension, coalesce({c}, '(none)') AS value, count(*) AS n FROM q GROUP BY 2" for n, c in _DIMS.items()),
    "count_group_report": f"""WITH {QUESTIONS} SELECT coalesce(role, '(none)') AS grp, count(*) AS n_total, count(*) FILTER (lower(trim(status)) = 'exported') AS n_exported,
      count(*) FILTER (lower(trim(status)) = 'rejected') AS n_rejected, count(*) FILTER (answer_status = 'annulled') AS n_annulled FROM q GROUP BY 1""",
    "count_completeness": f"WITH {QUESTIONS} " + " UNION ALL ".join(f"SELECT '{c}' AS field_name, count({c}) AS n_filled, round(count({c})::double / count(*), 6) AS share FROM q" for c in _FIELDS),
    "count_status": "SELECT v AS value, count(s) AS n FROM (SELECT unnest(['exported', 'approved', 'pending', 'exception', 'rejected', 'withdrawn']) AS v) LEFT JOIN (SELECT lower(trim(status)) AS s FROM questions) ON s = v GROUP BY 1",
    "count_flags": "SELECT value, count(*) AS n FROM (SELECT unnest(flags_json::json::varchar[]) AS value FROM questions WHERE json_valid(flags_json)) GROUP BY 1",
    "count_top_groups": f"WITH {QUESTIONS} SELECT board, level, year, count(*) AS n FROM q WHERE subject IS NULL OR subject = '' GROUP BY ALL ORDER BY n DESC, board NULLS LAST, level NULLS LAST, year NULLS LAST LIMIT 30",
    "count_suggestions": """SELECT * FROM (SELECT count(*) AS n_suggestions, count(DISTINCT question_id) AS n_questions, count(*) FILTER (is_official) AS n_official FROM desktop_answer_suggestions),
      (SELECT count(*) AS n_stored, count(deleted_at) AS n_deleted FROM questions)""",
    "count_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES),
    "count_contexts": """SELECT coalesce(role_id, '(none)') AS role, coalesce(shift_id, '(none)') AS shift, count(*) AS n, count(DISTINCT CASE WHEN answer_status = 'matched' THEN question_id END) AS n_matched_questions,
      count(DISTINCT booklet_id) AS n_booklets FROM question_occurrences GROUP BY 1, 2""",
    "count_document_rollup": f"""WITH {QUESTIONS}, r AS (SELECT document_id, coalesce(answer_status = 'matched', false) AS inc, coalesce(answer_status, 'unknown') AS reason FROM q)
      SELECT document_id, count(*) FILTER (inc) AS n_included, count(*) FILTER (NOT inc) AS n_excluded, coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (NOT inc)), '|'), '') AS reasons FROM r GROUP BY 1""",
    "count_ordered_values": f"""WITH {QUESTIONS}, f AS (SELECT document_id, level, min((question_number, id)) AS o FROM q WHERE level IS NOT NULL GROUP BY 1, 2)
      SELECT document_id, array_to_string(list(level ORDER BY o), '|') AS vals FROM f GROUP BY 1""",
    "count_field_ratio": f"""WITH s AS (SELECT model, coalesce(confidence >= 0.7, false) AS a, coalesce(suggested_answer = confirmed_answer, false) AS c FROM desktop_answer_suggestions),
      t AS (SELECT model, count(*) AS n, count(*) FILTER (a) AS n_accepted, count(*) FILTER (a AND c) AS r FROM s GROUP BY 1)
      SELECT model, n, n_accepted, {percent('r', 'n_accepted')} AS precision, {percent('n_accepted', 'n')} AS coverage, {percent('(n - n_accepted)', 'n')} AS review_rate FROM t""",
    "count_coverage": f"""WITH t AS (SELECT resolution_status, count(*) AS n_units, count(document_version_id) AS n_covered FROM document_observations GROUP BY 1) SELECT *, {percent('n_covered', 'n_units')} AS percent FROM t""",
    "event_summary": """SELECT event_type, count(*) AS n, sum(value::decimal(20,6))::double AS total, max(value) AS most, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""",
    "event_props": "SELECT event_type, count(*) AS n, max(k) AS k_max FROM (SELECT event_type, json_extract_string(props, '$.k')::int AS k FROM events) WHERE k >= 50 GROUP BY 1",
    "event_hourly": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value::decimal(20,6))::double AS total FROM events GROUP BY ALL",
    "event_latest": "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "event_recent": "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25",
    "event_sessions": """WITH e AS (SELECT user_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000)::int, 1) AS s FROM events)
      SELECT user_id, sum(s)::bigint AS n_sessions, count(*) AS n_events FROM e GROUP BY 1""",
    "order_status_priority": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_totalprice::decimal(20,2))::double AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "line_consensus": """WITH g AS (SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_returnflag) AS k, count(*) FILTER (l_linestatus = 'O') AS m FROM lineitem GROUP BY 1)
      SELECT l_orderkey, n_rows, k::int AS n_answers, CASE WHEN k > 1 THEN 'conflict' WHEN m > 0 THEN 'incomplete' WHEN k = 1 THEN 'confirmed' ELSE 'needs_review' END AS group_status FROM g""",
    "line_conditional_distinct": """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT CASE WHEN l_discount > 0.05 THEN l_suppkey END) AS n_suppliers,
      sum((l_extendedprice * (1 - l_discount))::decimal(24,4))::double AS revenue FROM lineitem GROUP BY 1, 2""",
    "allocation_by_area": """WITH s AS (SELECT area_code, count(*) AS n_docs FROM doc_labels GROUP BY 1), x AS (SELECT *, n_docs * 100 / sum(n_docs) OVER ()::double AS exact FROM s),
      f AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, n_docs DESC, area_code) AS rk, 100 - sum(floor(exact)) OVER () AS seats_left FROM x)
      SELECT area_code, n_docs, (fl + (rk <= seats_left)::int)::int AS share FROM f""",
    "count_model_accuracy": f"""
WITH t AS (SELECT model, provider, count(*) FILTER (coalesce(suggested_answer = confirmed_answer, false)) AS n_correct, count(*) AS n_total FROM desktop_answer_suggestions WHERE confirmed_answer IS NOT NULL GROUP BY 1, 2)
SELECT *, {percent('n_correct', 'n_total')} AS accuracy, {wilson('n_correct', 'n_total', True)} AS ci_low, {wilson('n_correct', 'n_total', False)} AS ci_high FROM t""",
}
