"""Answer-key association, readiness, representatives, catalogue and lineage queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions import text
from lauda.operators import association as a
from lauda.operators import dedup, joins, linkage, quality, windows
from lauda.records import questions
from lauda.session import table
from lauda.sqltext import QUESTIONS, fold

PROFILE = "board string, year int, role string, title string"
COVERAGE = "first int, last int"


def _versions(spark, sf_dir):
    """Living document versions with their typed profile; arrays hold one folded value or none."""
    v = table(spark, sf_dir, "document_versions").filter("deleted_at is null").select(
        "id", "document_role", "answer_key_state", "predecessor_version_id", F.from_json("profile_json", PROFILE).alias("p"), F.from_json("coverage_json", COVERAGE).alias("c")
    )
    one = lambda c: F.when(c.isNotNull(), F.array(text.fold(c.cast("string")))).otherwise(F.array().cast("array<string>"))
    return v.select(
        "id", "document_role", F.col("answer_key_state").alias("phase"), text.fold(F.col("p.board")).alias("board"), F.col("p.year").alias("year"), text.fold(F.col("p.role")).alias("role"),
        text.fold(F.col("p.title")).alias("title"), one(F.col("p.role")).alias("roles"), one(F.concat_ws("-", F.col("c.first"), F.col("c.last"))).alias("span"),
        F.nullif(F.lower(F.trim("predecessor_version_id")), F.lit("")).alias("predecessor"), (F.col("document_role") == "answer_key").alias("active"),
    )


def _pairs(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return a.candidates(v.filter("document_role = 'exam'"), v.filter("document_role = 'answer_key'"), ["board", "year"])


def assoc_candidates(spark, sf_dir):
    """Active keys that share board and year with each exam."""
    return _pairs(spark, sf_dir).select(F.col("e_id").alias("exam_id"), F.col("k_id").alias("key_id"))


KEY_FIELDS = [linkage.Evidence("role", "e_roles", "k_roles", 10, True), linkage.Evidence("span", "e_span", "k_span", 12)]


def assoc_evidence(spark, sf_dir):
    """Exams against keys of one board and year: role and number range as evidence, definitive keys ahead."""
    spanless = [linkage.Evidence(e.name, e.left, e.right, e.weight, e.required) for e in KEY_FIELDS[:1]]
    bonus = F.when(F.col("e_span") == F.col("k_span"), 12).otherwise(0) + F.when(F.col("k_phase") == "definitive", 8).otherwise(0)
    return linkage.decide(linkage.assess(_pairs(spark, sf_dir), spanless, bonus), "e_id", "k_id", 12, 8)


def assoc_older_choice(spark, sf_dir):
    """The same pairs by the older rule: least score, definitive tie-break, successor exception."""
    p = _pairs(spark, sf_dir)
    score = F.lit(24) + F.when(F.col("e_role") == F.col("k_role"), 12).otherwise(0) + F.least(F.lit(a.TITLE_BONUS), F.size(F.array_intersect(F.split("e_title", " "), F.split("k_title", " "))))
    return a.older_choice(p.select(F.col("e_id").alias("exam_id"), F.col("k_id").alias("key_id"), score.alias("score"), F.col("k_phase").alias("phase"), F.col("k_predecessor").alias("predecessor")), "exam_id", "key_id")


_PARTS = ["contest_id", "application_id", "role_id", "stage_id", "shift_id", "booklet_id"]


def assoc_key_selection(spark, sf_dir):
    """Exam sittings against the keys published for their contest, application and role, by weighted evidence
    with pools and margin; a key's phase is what its answers say."""
    o = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "ingested_at", "answer_status", "original_number", *_PARTS), ["id"], ["ingested_at"])
    o = o.filter("contest_id is not null and application_id is not null and role_id is not null")
    name = lambda *cs: F.concat_ws("/", *[F.coalesce(c, F.lit("-")) for c in cs])
    phase = F.when(F.col("answer_status") == "matched", "definitive").when(F.col("answer_status") == "annulled", "preliminary").otherwise("unknown")
    span = o.groupBy("contest_id").agg(F.struct(F.min("original_number").alias("first"), F.max("original_number").alias("last")).alias("interval"))
    side = {"e": o.select(*_PARTS).distinct(), "k": o.select(*_PARTS, phase.alias("phase")).distinct()}
    field = {"board": "contest_id", "concurso": "contest_id", "year": "contest_id", "organization": "application_id", "role": "role_id", "stage": "stage_id", "turn": "shift_id", "variant": "booklet_id"}
    block = _PARTS[:3]

    def view(p):
        d = side[p].join(span, "contest_id")
        arrays = [F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>")).alias(f"{p}_{f}") for f, c in field.items()]
        weak = [F.lit(False).alias(f"{p}_{f}_weak") for f in field]
        ids = [name(*[F.col(c) for c in _PARTS], *([F.col("phase")] if p == "k" else [])).alias("exam" if p == "e" else "key"), F.col("interval").alias(f"{p}_interval")]
        return d.select(*block, *arrays, *weak, *ids, *([F.col("phase").alias("k_phase")] if p == "k" else []))

    pairs = view("e").join(view("k"), block)
    return linkage.select_keys(linkage.assess_keys(pairs), "exam", "key")


def assoc_blocked_pairs(spark, sf_dir):
    """Exams with keys of the same board and year: same title, else same role, else any."""
    v = _versions(spark, sf_dir)
    e, k = v.filter("document_role = 'exam'").withColumnRenamed("id", "exam_id"), v.filter("document_role = 'answer_key'").withColumnRenamed("id", "key_id")
    return a.blocked_pairs(e, k, ["board", "year"], [["title"], ["role"], []], "exam_id", "key_id")


def assoc_audit(spark, sf_dir):
    """Confirmed suggestions against the answers of the occurrences, per question."""
    key = F.nullif(F.lower(F.trim("question_id")), F.lit(""))
    s = table(spark, sf_dir, "desktop_answer_suggestions").filter("status = 'confirmed'").groupBy(key.alias("question")).agg(F.min("confirmed_answer").alias("answer")).filter("question is not null")
    o = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "question_id", "answer_status", "answer_letter", "ingested_at"), ["id"], ["ingested_at"])
    r = o.filter("answer_status = 'matched'").groupBy(key.alias("question")).agg(F.min("answer_letter").alias("answer")).filter("question is not null")
    return a.audit(s, r, "question", "answer")


def assoc_audit_applied(spark, sf_dir):
    """State and value counts after applying the audit without replacing what differs."""
    return a.apply_audit(assoc_audit(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


def assoc_catalog(spark, sf_dir):
    """Rows and names per level of the contest hierarchy, with surrogate keys."""
    o = table(spark, sf_dir, "question_occurrences").select(*_PARTS[:4])
    out = None
    for level, d in a.register(o, _PARTS[:4]).items():
        rows = d.select(F.lit(level).alias("level"), "key", "parent_key", "name", "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


def assoc_backfill(spark, sf_dir):
    """Versions to documents by content digest of their observations: mapped, ambiguous or unmapped."""
    hexed = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?", ""), "[^0-9a-f]", ""), F.lit(""))
    v = table(spark, sf_dir, "document_versions").select("id", hexed("content_sha256").alias("digest"))
    o = table(spark, sf_dir, "document_observations").select(hexed("binary_sha256").alias("digest"), "document_id")
    b = table(spark, sf_dir, "import_batches").select(F.col("id"), hexed("source_sha256").alias("digest"))
    return a.backfill(v.unionByName(b), o, "digest", "document_id").groupBy("outcome").agg(F.count("*").alias("n"))


def assoc_lineage(spark, sf_dir):
    """Question to document edges of the first loads against those of all, by latest row."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null")
    old = q.filter("load_no < 4").select("document_id", "question_number")
    new = q.filter("load_no >= 2").select("document_id", "question_number")
    return a.reconcile(old, new, ["document_id", "question_number"]).groupBy("state").agg(F.count("*").alias("n"))


def assoc_top_sources(spark, sf_dir):
    """The 50 sources that filtered most questions out, one per URL without fragment."""
    b = table(spark, sf_dir, "import_batches").filter("source_url is not null")
    return a.top_distinct(b, "filtered_out_questions", "source_url", 1, 50)


def assoc_letter_map(spark, sf_dir):
    """Letters of each question mapped to those of the first question with the same statement."""
    q = questions(spark, sf_dir).select("id", text.comparison_key(F.col("statement")).alias("k"), F.transform("alternatives", lambda x: F.struct(x["letter"].alias("letter"), x["text"].alias("text"))).alias("alts"))
    q = q.filter("k <> ''").withColumn("k", F.sha2("k", 256))
    first = q.groupBy("k").agg(F.min_by("alts", "id").alias("ref"), F.min("id").alias("ref_id"), F.count("*").alias("n")).filter("n > 1")
    mapped = q.join(first, "k").filter("id <> ref_id").select("id", "ref_id", F.map_entries(a.letter_map(F.col("alts"), F.col("ref"))).alias("m"))
    return mapped.select("id", "ref_id", F.array_join(F.array_sort(F.transform("m", lambda e: F.concat(e["key"], F.lit(">"), e["value"]))), ",").alias("letters"))


def assoc_answer_consensus(spark, sf_dir):
    """Do questions of one statement and near alternatives name the same answer, whatever its letter?"""
    q = questions(spark, sf_dir).select(
        "id", "discipline", F.col("document_id").alias("booklet"), text.comparison_key(text.question_text(F.col("statement"))).alias("skey"), "correct_answer",
        F.transform("alternatives", lambda x: F.coalesce(x["text"], F.lit(""))).alias("alts"), F.get(F.filter("alternatives", lambda x: x["letter"] == F.col("correct_answer")), F.lit(0))["text"].alias("answer_text"),
    )
    q = q.withColumn("ckey", F.sha2(F.array_join(F.array_sort(F.transform("alts", text.comparison_key)), "|"), 256)).withColumn("skey", F.sha2("skey", 256))
    units = dedup.exact_units(q, ["discipline"], "skey", "ckey", "booklet")
    clusters = dedup.near_clusters(units, ["discipline"], "skey", "ckey")
    own = units.select("unit_id", F.col("discipline").alias("_d"), F.col("skey").alias("_s"), F.col("ckey").alias("_c"))
    placed = clusters.join(own, "unit_id").select("cluster_id", "_d", "_s", "_c")
    same = F.col("discipline").eqNullSafe(F.col("_d")) & F.col("skey").eqNullSafe(F.col("_s")) & F.col("ckey").eqNullSafe(F.col("_c"))
    members = q.join(placed, same).select(F.col("cluster_id").alias("group_id"), "answer_text", "alts")
    reps = units.select(F.col("unit_id").alias("group_id"), F.col("alts").alias("rep_alts")).join(clusters.select(F.col("cluster_id").alias("group_id")).distinct(), "group_id", "left_semi")
    return dedup.answer_consensus(members, "group_id", reps)


def assoc_readiness(spark, sf_dir):
    """All thirteen issue codes of import readiness, counted over the questions."""
    q = table(spark, sf_dir, "questions").select("id")
    rec = questions(spark, sf_dir)
    seen = table(spark, sf_dir, "document_observations").filter("document_id is not null").groupBy("document_id").agg(F.count_distinct("document_version_id").alias("n_versions"))
    occ = windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "question_id", "answer_letter", "ingested_at"), ["id"], ["ingested_at"])
    letters = occ.groupBy(F.lower(F.trim("question_id")).alias("qid")).agg(F.count_distinct("answer_letter").alias("n_letters"))
    copies = rec.groupBy("fingerprint").agg(F.count("*").alias("n_same"))
    d = rec.join(seen, "document_id", "left").join(letters, F.col("id") == F.col("qid"), "left").join(copies.filter("fingerprint is not null"), "fingerprint", "left")
    tests = quality.record_issues() | {
        "unproved_origin": F.col("n_versions").isNull(),
        "unresolved_duplicate": F.coalesce("n_same", F.lit(1)) > 1,
        "ambiguous_association": F.coalesce("n_letters", F.lit(0)) > 1,
        "version_conflict": F.coalesce("n_versions", F.lit(0)) > 1,
    }
    r = joins.exists(d, q, ["id"]).select(quality.import_readiness(tests).alias("r"))
    return r.select(F.explode(F.when(F.col("r.importable"), F.array(F.lit("importable"))).otherwise(F.col("r.issues"))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def assoc_gate(spark, sf_dir):
    """The gate over all seven dimensions, questions per outcome."""
    rec = questions(spark, sf_dir)
    tests = quality.record_issues()
    flags = {c: F.coalesce(t, F.lit(True)).alias(c) for c, t in tests.items()}
    d = rec.select("id", "fingerprint", "document_id", "confidence", *flags.values()).withColumn("first", F.col("fingerprint").isNull() | a.first_of_content(rec, "fingerprint", "id"))
    ok = lambda *codes: ~F.exists(F.array(*map(F.col, codes)), lambda x: x)
    dims = {
        "origin": F.col("document_id").isNotNull() & ok("missing_source_page"), "structure": ok("invalid_statement", "invalid_alternatives"), "answer": ok("missing_official_answer"), "visual": ok("visual_content"),
        "extraction": F.coalesce(F.col("confidence") >= 0.65, F.lit(False)), "taxonomy": ok("missing_classification"), "deduplication": F.col("first"),
    }
    return d.select(quality.gate(dims, ["origin", "structure"]).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def assoc_representatives(spark, sf_dir):
    """One occurrence per statement by all nine ranks."""
    o = windows.latest_per_key(
        table(spark, sf_dir, "question_occurrences").select("id", "ingested_at", "question_id", "document_id", "document_version_id", "statement_fingerprint", "answer_status", "answer_link_valid", "occurrence_status"), ["id"], ["ingested_at"]
    ).filter("statement_fingerprint is not null")
    low = lambda c: F.lower(F.trim(c))
    q = questions(spark, sf_dir, "flags_json").select(
        F.col("id").alias("q_id"), low("status").alias("q_status"), F.coalesce(F.size(F.from_json("flags_json", "array<string>")), F.lit(0)).alias("n_flags"),
        ((F.length(F.trim(F.coalesce("statement", F.lit("")))) > 0).cast("int") + (F.coalesce(F.size("alternatives"), F.lit(0)) >= 2).cast("int") + (F.coalesce(F.size("source_pages"), F.lit(0)) > 0).cast("int")).alias("complete"),
    )
    v = table(spark, sf_dir, "document_versions").select(F.col("id").alias("v_id"), "answer_key_state", F.col("deleted_at").isNull().alias("living"))
    d = o.join(q, low("question_id") == F.col("q_id"), "left").join(v, low("document_version_id") == F.col("v_id"), "left")
    no = lambda p: (~F.coalesce(p, F.lit(False))).cast("int")
    ranks = [
        no(F.col("q_status").isin("approved", "exported")), no(F.col("answer_key_state") == "definitive"), no(F.col("answer_link_valid")), no(F.col("occurrence_status") == "active"),
        -(F.coalesce("complete", F.lit(0)) + F.coalesce(F.col("answer_status").isin("matched", "annulled"), F.lit(False)).cast("int")), no(F.col("living")), F.coalesce("n_flags", F.lit(0)),
        F.coalesce("document_id", F.lit("")), F.col("id"),
    ]
    return a.representatives(d, "statement_fingerprint", ranks).select("statement_fingerprint", "id")


def assoc_scopes(spark, sf_dir):
    """Questions in the canonical and in the answered scope."""
    q = questions(spark, sf_dir)
    s = F.lower(F.trim("status"))
    letters = F.transform("alternatives", lambda x: x["letter"])
    answered = (F.col("answer_status") == "matched") & F.array_contains(letters, F.col("correct_answer")) & (F.size("source_pages") > 0)
    of = lambda scope: F.count_if(quality.in_scope(scope, F.when(s.isin("approved", "exported"), "confirmed").otherwise(s), F.col("updated_at") >= F.col("created_at"), s == "exception", s == "rejected", answered))
    return q.agg(of("canonical").alias("n_canonical"), of("answered").alias("n_answered"), F.count("*").alias("n"))


def assoc_diversity(spark, sf_dir):
    """Questions per source-diversity group (seven parts), the groups of more than one."""
    q = questions(spark, sf_dir)
    parts = ["board", "organization", "role", "year", "level", "discipline", "matter"]
    key = a.surrogate(*[text.fold(F.col(c).cast("string")) for c in parts])
    return q.groupBy(key.alias("group_key")).agg(F.count("*").alias("n")).filter("n > 1")


def assoc_summary(spark, sf_dir):
    """Accuracy, decided share, median and longest decision time of suggestions; rates are null without a base."""
    s = table(spark, sf_dir, "desktop_answer_suggestions")
    days = F.datediff("decided_at", "created_at")
    return s.groupBy("model").agg(
        F.round(F.try_divide(F.count_if(F.col("confirmed_answer") == F.col("suggested_answer")), F.count("confirmed_answer")), 6).alias("accuracy"),
        F.round(F.try_divide(F.count("decided_at"), F.count("*")), 6).alias("decided"), F.median(days).alias("median_days"), F.max(days).alias("most_days"),
    )


QUERIES = {k: v for k, v in globals().items() if k.startswith("assoc_") and callable(v)}

_V = f"""v AS (SELECT id, document_role, answer_key_state AS phase, {fold("profile_json->>'board'")} AS board, TRY_CAST(profile_json->>'year' AS INT) AS year, {fold("profile_json->>'role'")} AS role,
  {fold("profile_json->>'title'")} AS title, concat_ws('-', coverage_json->>'first', coverage_json->>'last') AS span, nullif(lower(trim(predecessor_version_id)), '') AS predecessor FROM document_versions WHERE deleted_at IS NULL),
p AS (SELECT e.id AS e_id, k.id AS k_id, e.role AS e_role, k.role AS k_role, e.span AS e_span, k.span AS k_span, e.title AS e_title, k.title AS k_title, k.phase, k.predecessor FROM v e JOIN v k ON e.board = k.board AND e.year = k.year WHERE e.document_role = 'exam' AND k.document_role = 'answer_key')"""
_OCC = "o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM question_occurrences) WHERE rn = 1)"
_HEX = "nullif(regexp_replace(regexp_replace(lower({0}), '^\\s*sha-?256\\s*[:=]?', ''), '[^0-9a-f]', '', 'g'), '')"


def _surrogate(*cs: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(f"coalesce('=' || {c}, '-')" for c in cs) + "))"


def _level(n: int) -> str:
    cs, above = _PARTS[: n + 1], _PARTS[:n]
    return f"SELECT '{cs[-1]}' AS level, {_surrogate(*cs)} AS key, {_surrogate(*above) if above else 'NULL::varchar'} AS parent_key, {cs[-1]} AS name, count(*) AS n_rows FROM question_occurrences WHERE {cs[-1]} IS NOT NULL GROUP BY {', '.join(cs)}"


_K = "regexp_replace(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_NAME = "concat_ws('/', " + ", ".join(f"coalesce({{0}}{c}, '-')" for c in _PARTS)
_GOOD = "len(letters) BETWEEN 2 AND 5 AND letters = list_slice(['A','B','C','D','E','F','G','H'], 1, len(letters))"
_VISUAL = " OR ".join(f"contains({fold("concat_ws(' ', statement, array_to_string(texts, ' '))")}, '{m}')" for m in quality.VISUAL)


def _short(*cs: str) -> str:
    return "(" + " OR ".join(f"length(trim(coalesce({c}, ''))) < 2" for c in cs) + ")"


_ISSUES = f"""i AS (SELECT *, {_short('discipline', 'matter', 'subject')} AS missing_classification, {_short('board', 'organization', 'role', 'level')} AS missing_metadata, year IS NULL AS missing_year,
  coalesce(n_pages, 0) < 1 AS missing_source_page, length(trim(coalesce(statement, ''))) < 10 AS invalid_statement, NOT coalesce(answer_status IN ('matched', 'annulled'), false) AS missing_official_answer,
  coalesce(answer_status = 'annulled', false) AS annulled_answer, NOT coalesce({_GOOD}, false) AS invalid_alternatives, coalesce({_VISUAL}, false) AS visual_content FROM q)"""
_CODES = ", ".join(f"CASE WHEN coalesce({c}, true) THEN '{c}' END" for c in quality.IMPORT_CODES)

ORACLE = {
    "assoc_candidates": f"WITH {_V} SELECT e_id AS exam_id, k_id AS key_id FROM p",
    "assoc_evidence": f"""WITH {_V}, s AS (SELECT e_id, k_id, CASE WHEN e_role <> k_role THEN 'conflict' WHEN e_role IS NULL OR k_role IS NULL THEN 'incomplete' ELSE 'comparable' END AS state,
  (CASE WHEN e_role = k_role THEN 10 ELSE 0 END + CASE WHEN e_span = k_span THEN 12 ELSE 0 END + CASE WHEN phase = 'definitive' THEN 8 ELSE 0 END)::int AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY e_id, state ORDER BY score DESC, k_id DESC) AS rk FROM s),
g AS (SELECT e_id, count(*) AS n_candidates, count(*) FILTER (state = 'comparable') AS n_comparable, count(*) FILTER (state = 'incomplete') AS ni, max(score) FILTER (state = 'comparable' AND rk = 1) AS s1,
  max(k_id) FILTER (state = 'comparable' AND rk = 1) AS c1, max(score) FILTER (state = 'comparable' AND rk = 2) AS s2 FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN n_comparable = 0 THEN CASE WHEN ni > 0 THEN 'incomplete' ELSE 'conflict' END WHEN s1 < 12 THEN 'below_minimum' WHEN s1 - coalesce(s2, -1000000) < 8 THEN 'ambiguous' ELSE 'selected' END AS outcome FROM g)
SELECT e_id, n_candidates, n_comparable, outcome, s1 AS best_score, CASE WHEN outcome = 'selected' THEN c1 END AS chosen FROM x""",
    "assoc_older_choice": f"""WITH {_V}, s AS (SELECT e_id AS exam_id, k_id AS key_id, phase, predecessor, (24 + CASE WHEN e_role = k_role THEN 12 ELSE 0 END + least(2, len(list_intersect(string_split(e_title, ' '), string_split(k_title, ' ')))))::int AS score FROM p),
b AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY exam_id) AS top FROM s) WHERE score = top),
m AS (SELECT b.*, EXISTS (SELECT 1 FROM b c WHERE c.exam_id = b.exam_id AND c.predecessor = b.key_id) AS old FROM b),
g AS (SELECT exam_id, max(top) AS best_score, count(*) AS n_best, min(key_id) AS one, count(*) FILTER (phase = 'definitive') AS nd, min(key_id) FILTER (phase = 'definitive') AS d, count(*) FILTER (NOT old) AS nl, min(key_id) FILTER (NOT old) AS l FROM m GROUP BY 1),
c AS (SELECT *, CASE WHEN best_score >= 36 THEN CASE WHEN n_best = 1 THEN one WHEN nd = 1 THEN d WHEN nl = 1 THEN l END END AS chosen FROM g)
SELECT exam_id, best_score, n_best, CASE WHEN best_score < 36 THEN 'below_minimum' WHEN chosen IS NULL THEN 'ambiguous' ELSE 'selected' END AS outcome, chosen FROM c""",
    "assoc_key_selection": f"""WITH {_OCC}, f AS (SELECT * FROM o WHERE contest_id IS NOT NULL AND application_id IS NOT NULL AND role_id IS NOT NULL),
e AS (SELECT DISTINCT {', '.join(_PARTS)} FROM f), k AS (SELECT DISTINCT {', '.join(_PARTS)}, CASE answer_status WHEN 'matched' THEN 'definitive' WHEN 'annulled' THEN 'preliminary' ELSE 'unknown' END AS phase FROM f),
s AS (SELECT {_NAME.format('e.')}) AS exam, {_NAME.format('k.')}, k.phase) AS key, k.phase,
  CASE WHEN coalesce(e.stage_id <> k.stage_id, false) OR coalesce(e.shift_id <> k.shift_id, false) OR coalesce(e.booklet_id <> k.booklet_id, false) THEN 'conflict'
    WHEN e.stage_id IS NULL OR k.stage_id IS NULL OR e.booklet_id IS NULL OR k.booklet_id IS NULL THEN 'incomplete' ELSE 'comparable' END AS state,
  (66 + CASE WHEN e.stage_id = k.stage_id THEN 8 ELSE 0 END + CASE WHEN e.shift_id = k.shift_id THEN 8 ELSE 0 END + CASE WHEN e.booklet_id = k.booklet_id THEN 8 ELSE 0 END + CASE WHEN k.phase = 'definitive' THEN 8 ELSE 0 END)::int AS score
  FROM e JOIN k ON e.contest_id = k.contest_id AND e.application_id = k.application_id AND e.role_id = k.role_id),
l AS (SELECT *, CASE WHEN state = 'comparable' AND score >= 82 THEN CASE phase WHEN 'definitive' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END END AS pool FROM s),
b AS (SELECT *, min(pool) OVER (PARTITION BY exam) AS best FROM l),
r AS (SELECT *, CASE WHEN pool = best AND pool < 3 THEN row_number() OVER (PARTITION BY exam, pool ORDER BY score DESC, key DESC) END AS rk FROM b),
g AS (SELECT exam, min(best) AS best, count(*) FILTER (state = 'incomplete') AS ni, count(*) FILTER (state = 'conflict') AS nc, max(score) FILTER (rk = 1) AS s1, max(key) FILTER (rk = 1) AS c1, max(score) FILTER (rk = 2) AS s2 FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN best IS NULL THEN CASE WHEN ni > 0 THEN 'incomplete' WHEN nc > 0 THEN 'conflict' ELSE 'insufficient_evidence' END WHEN best = 3 THEN 'awaiting_definitive' WHEN s1 - s2 < 8 THEN 'ambiguous' ELSE 'selected' END AS outcome FROM g)
SELECT exam, outcome, CASE WHEN outcome = 'selected' THEN c1 END AS chosen, s1 AS best_score, s1 - s2 AS margin FROM x""",
    "assoc_blocked_pairs": f"""WITH {_V}, t AS (SELECT e_id, k_id, CASE WHEN e_title = k_title THEN 1 WHEN e_role = k_role THEN 2 ELSE 3 END AS tier FROM p), m AS (SELECT *, min(tier) OVER (PARTITION BY e_id) AS best FROM t)
SELECT DISTINCT e_id AS exam_id, k_id AS key_id, best::int AS tier FROM m WHERE CASE best WHEN 1 THEN tier = 1 WHEN 2 THEN tier = 2 ELSE true END""",
    "assoc_audit": f"""WITH {_OCC}, c AS (SELECT nullif(lower(trim(question_id)), '') AS question, min(confirmed_answer) AS current FROM desktop_answer_suggestions WHERE status = 'confirmed' GROUP BY 1),
r AS (SELECT nullif(lower(trim(question_id)), '') AS question, min(answer_letter) AS recommended FROM o WHERE answer_status = 'matched' GROUP BY 1)
SELECT question, current, recommended, CASE WHEN current IS NULL AND recommended IS NULL THEN 'open' WHEN current IS NULL THEN 'missing' WHEN recommended IS NULL THEN 'unsupported' WHEN current = recommended THEN 'confirmed' ELSE 'divergent' END AS state
FROM (SELECT * FROM c WHERE question IS NOT NULL) FULL JOIN (SELECT * FROM r WHERE question IS NOT NULL) USING (question)""",
    "assoc_audit_applied": f"""WITH {_OCC}, c AS (SELECT nullif(lower(trim(question_id)), '') AS question, min(confirmed_answer) AS current FROM desktop_answer_suggestions WHERE status = 'confirmed' GROUP BY 1),
r AS (SELECT nullif(lower(trim(question_id)), '') AS question, min(answer_letter) AS recommended FROM o WHERE answer_status = 'matched' GROUP BY 1)
SELECT coalesce(current, recommended) AS value, count(*) AS n FROM (SELECT * FROM c WHERE question IS NOT NULL) FULL JOIN (SELECT * FROM r WHERE question IS NOT NULL) USING (question) GROUP BY 1""",
    "assoc_catalog": " UNION ALL ".join(_level(n) for n in range(4)),
    "assoc_backfill": f"""WITH x AS (SELECT id, {_HEX.format('content_sha256')} AS digest FROM document_versions UNION ALL SELECT id, {_HEX.format('source_sha256')} FROM import_batches),
k AS (SELECT {_HEX.format('binary_sha256')} AS digest, count(DISTINCT document_id) AS n FROM document_observations WHERE document_id IS NOT NULL GROUP BY 1)
SELECT CASE WHEN k.n = 1 THEN 'mapped' WHEN k.n > 1 THEN 'ambiguous' ELSE 'unmapped' END AS outcome, count(*) AS n FROM x LEFT JOIN k ON x.digest = k.digest GROUP BY 1""",
    "assoc_lineage": """WITH a AS (SELECT DISTINCT document_id, coalesce(question_number, -1) AS n FROM questions WHERE document_id IS NOT NULL AND load_no < 4), b AS (SELECT DISTINCT document_id, coalesce(question_number, -1) AS n FROM questions WHERE document_id IS NOT NULL AND load_no >= 2)
SELECT CASE WHEN b.n IS NULL THEN 'archived' WHEN a.n IS NULL THEN 'added' ELSE 'kept' END AS state, count(*) AS n FROM a FULL JOIN b ON a.document_id = b.document_id AND a.n = b.n GROUP BY 1""",
    "assoc_top_sources": "SELECT regexp_replace(source_url, '#.*$', '') AS url_key, max(filtered_out_questions) AS filtered_out_questions FROM import_batches WHERE source_url IS NOT NULL AND filtered_out_questions >= 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "assoc_letter_map": f"""WITH {QUESTIONS}, s AS (SELECT id, sha256({_K.format('statement')}) AS k, letters, texts FROM q WHERE {_K.format('statement')} <> ''),
f AS (SELECT k, min(id) AS ref_id FROM s GROUP BY 1 HAVING count(*) > 1), al AS (SELECT id, unnest(letters) AS letter, {_K.format("coalesce(unnest(texts), '')")} AS t, generate_subscripts(letters, 1) AS pos FROM s),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, letter ORDER BY pos) AS rn FROM al WHERE letter IS NOT NULL AND t <> '') WHERE rn = 1), ref AS (SELECT id, t, min(letter) AS letter FROM al GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s.id, f.ref_id, coalesce(array_to_string(list_sort(list(own.letter || '>' || ref.letter) FILTER (ref.letter IS NOT NULL)), ','), '') AS letters
FROM s JOIN f ON s.k = f.k AND s.id <> f.ref_id LEFT JOIN own ON own.id = s.id LEFT JOIN ref ON ref.id = f.ref_id AND ref.t = own.t GROUP BY 1, 2""",
    "assoc_readiness": f"""WITH {QUESTIONS}, {_OCC}, {_ISSUES}, sv AS (SELECT document_id, count(DISTINCT document_version_id) AS nv FROM document_observations WHERE document_id IS NOT NULL GROUP BY 1),
lt AS (SELECT lower(trim(question_id)) AS qid, count(DISTINCT answer_letter) AS nl FROM o GROUP BY 1), cp AS (SELECT fingerprint, count(*) AS ns FROM q WHERE fingerprint IS NOT NULL GROUP BY 1),
j AS (SELECT i.*, sv.nv IS NULL AS unproved_origin, coalesce(cp.ns, 1) > 1 AS unresolved_duplicate, coalesce(lt.nl, 0) > 1 AS ambiguous_association, coalesce(sv.nv, 0) > 1 AS version_conflict
  FROM i LEFT JOIN sv ON sv.document_id = i.document_id LEFT JOIN lt ON lt.qid = i.id LEFT JOIN cp ON cp.fingerprint = i.fingerprint),
x AS (SELECT list_filter([{_CODES}], lambda c: c IS NOT NULL) AS issues FROM j)
SELECT code, count(*) AS n FROM (SELECT unnest(CASE WHEN len(issues) = 0 THEN ['importable'] ELSE issues END) AS code FROM x) GROUP BY 1""",
    "assoc_gate": f"""WITH {QUESTIONS}, {_ISSUES}, d AS (SELECT *, fingerprint IS NULL OR row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1 AS first FROM i)
SELECT CASE WHEN document_id IS NULL OR missing_source_page OR invalid_statement OR invalid_alternatives THEN 'quarantined'
  WHEN missing_official_answer OR visual_content OR NOT coalesce(confidence >= 0.65, false) OR missing_classification OR NOT first THEN 'needs_review' ELSE 'auto_ready' END AS outcome, count(*) AS n FROM d GROUP BY 1""",
    "assoc_representatives": f"""WITH {QUESTIONS}, {_OCC}, x AS (SELECT o.id, o.statement_fingerprint AS sf, row_number() OVER (PARTITION BY o.statement_fingerprint ORDER BY
    (NOT coalesce(lower(trim(q.status)) IN ('approved', 'exported'), false)), (NOT coalesce(v.answer_key_state = 'definitive', false)), (NOT coalesce(o.answer_link_valid, false)), (NOT coalesce(o.occurrence_status = 'active', false)),
    -(coalesce((length(trim(coalesce(q.statement, ''))) > 0)::int + (coalesce(q.n_alts, 0) >= 2)::int + (coalesce(q.n_pages, 0) > 0)::int, 0) * (q.id IS NOT NULL)::int + coalesce(o.answer_status IN ('matched', 'annulled'), false)::int),
    (NOT coalesce(v.id IS NOT NULL AND v.deleted_at IS NULL, false)), coalesce(json_array_length(CASE WHEN json_valid(f.flags_json) THEN f.flags_json END), 0), coalesce(o.document_id, ''), o.id) AS rn2
  FROM o LEFT JOIN q ON q.id = lower(trim(o.question_id)) LEFT JOIN questions f ON f.id = q.id LEFT JOIN document_versions v ON v.id = lower(trim(o.document_version_id)) WHERE o.statement_fingerprint IS NOT NULL)
SELECT sf AS statement_fingerprint, id FROM x WHERE rn2 = 1""",
    "assoc_scopes": f"""WITH {QUESTIONS}, s AS (SELECT *, lower(trim(status)) AS s FROM q), u AS (SELECT *, coalesce(updated_at >= created_at, false) AND NOT coalesce(s = 'exception', false) AND NOT coalesce(s = 'rejected', false) AS usable FROM s)
SELECT count(*) FILTER (usable AND coalesce(s IN ('approved', 'exported'), false)) AS n_canonical, count(*) FILTER (usable AND coalesce(answer_status = 'matched' AND list_contains(letters, correct_answer) AND n_pages > 0, false)) AS n_answered, count(*) AS n FROM u""",
    "assoc_diversity": f"WITH {QUESTIONS} SELECT {_surrogate(*[fold(f'{c}::varchar') for c in ('board', 'organization', 'role', 'year', 'level', 'discipline', 'matter')])} AS group_key, count(*) AS n FROM q GROUP BY 1 HAVING count(*) > 1",
    "assoc_summary": """SELECT model, round(count(*) FILTER (confirmed_answer = suggested_answer) / nullif(count(confirmed_answer), 0)::double, 6) AS accuracy, round(count(decided_at) / count(*)::double, 6) AS decided,
  median(date_diff('day', created_at, decided_at))::double AS median_days, max(date_diff('day', created_at, decided_at))::int AS most_days FROM desktop_answer_suggestions GROUP BY 1""",
}
