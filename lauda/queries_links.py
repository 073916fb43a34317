"""Join and linkage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lauda.functions import dates, stats, text, urls
from lauda.operators import classify, joins, linkage, sampling, setops, windows
from lauda.records import questions
from lauda.session import table
from lauda.sqltext import QUESTIONS, alnum, fold

_ONE = ["id"]


def _occ(spark, sf_dir, *cols):
    return windows.latest_per_key(table(spark, sf_dir, "question_occurrences").select("id", "ingested_at", *cols), ["id"], ["ingested_at"])


def _key(c):
    return F.nullif(F.trim(F.lower(F.col(c))), F.lit(""))


def link_left_chain(spark, sf_dir):
    """Occurrences with their question's status and their version's role, two left joins."""
    o = _occ(spark, sf_dir, "question_id", "document_version_id").select("id", _key("question_id").alias("qid"), _key("document_version_id").alias("vid"))
    q = table(spark, sf_dir, "questions").select(F.col("id").alias("q_key"), "status")
    v = table(spark, sf_dir, "document_versions").select(F.col("id").alias("v_key"), "document_role")
    return joins.left_chain(o, (q, "qid", "q_key"), (v, "vid", "v_key")).groupBy("status", "document_role").agg(F.count("*").alias("n"))


def link_left_filtered(spark, sf_dir):
    """Questions with their official suggestion, if any: the extra ON predicate keeps the left rows."""
    s = windows.latest_per_key(table(spark, sf_dir, "desktop_answer_suggestions").select(_key("question_id").alias("id"), "suggested_answer", "is_official", "created_at", F.col("id").alias("sid")), ["id", "sid"], ["created_at"])
    q = table(spark, sf_dir, "questions").select("id")
    both = joins.left_filtered(q, s, ["id"], F.coalesce("is_official", F.lit(False)))
    return both.groupBy("id").agg(F.min("suggested_answer").alias("official_answer"))


def link_exists(spark, sf_dir):
    o = table(spark, sf_dir, "question_occurrences").select(_key("question_id").alias("id"))
    return joins.exists(table(spark, sf_dir, "questions").select("id", "status"), o, _ONE)


def link_not_exists(spark, sf_dir):
    """Documents none of whose questions is rejected and that have at least one occurrence."""
    q = table(spark, sf_dir, "questions").select("document_id", F.lower(F.trim("status")).alias("s")).filter("document_id is not null")
    docs = q.select("document_id").distinct()
    clean = joins.not_exists(docs, q.filter("s = 'rejected'"), ["document_id"])
    return joins.exists(clean, table(spark, sf_dir, "question_occurrences").select("document_id"), ["document_id"])


def link_latest_value(spark, sf_dir):
    """Latest suggestion of every question by one aggregation."""
    s = table(spark, sf_dir, "desktop_answer_suggestions").select(_key("question_id").alias("id"), "suggested_answer", "created_at")
    return joins.latest_value(table(spark, sf_dir, "questions").select("id"), s, _ONE, "suggested_answer", "created_at")


def link_gathered(spark, sf_dir):
    """Booklets of each contest as one sorted text."""
    o = _occ(spark, sf_dir, "contest_id", "booklet_id").filter("contest_id is not null")
    return joins.gathered(o.select("contest_id").distinct(), o, ["contest_id"], "booklet_id").select("contest_id", F.array_join("booklet_id", "|").alias("booklets"))


def link_either_key(spark, sf_dir):
    """Observations that name a deleted version by document or by version, without an OR join."""
    dead = table(spark, sf_dir, "document_versions").filter("deleted_at is not null").select(F.col("id").alias("key"))
    o = table(spark, sf_dir, "document_observations").select("id", "document_id", "document_version_id")
    return joins.either_key(o, dead, ["document_id", "document_version_id"])


def link_compare_loads(spark, sf_dir):
    """What later loads add to or change in what earlier loads brought, by document and number."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null and question_number is not null")
    old = windows.latest_per_key(q.filter("load_no < 4").select("document_id", "question_number", "fingerprint", "updated_at", "id"), ["document_id", "question_number"], ["updated_at", "id"])
    new = windows.latest_per_key(q.filter("load_no >= 4").select("document_id", "question_number", "fingerprint", "updated_at", "id"), ["document_id", "question_number"], ["updated_at", "id"])
    return joins.compare_versions(old, new, ["document_id", "question_number"], "fingerprint").groupBy("change").agg(F.count("*").alias("n"))


def link_null_safe(spark, sf_dir):
    """Occurrences whose version differs from the one their document was observed with, null-safely."""
    o = _occ(spark, sf_dir, "document_id", "document_version_id").select("id", "document_id", _key("document_version_id").alias("v"))
    seen = windows.latest_per_key(table(spark, sf_dir, "document_observations").filter("document_id is not null").select("document_id", F.col("document_version_id").alias("w"), "last_seen_at", F.col("id").alias("oid")), ["document_id"], ["last_seen_at", "oid"])
    return o.join(seen, "document_id").filter(~F.col("v").eqNullSafe(F.lower(F.trim("w")))).agg(F.count("*").alias("n_differ"))


def link_apply_answers(spark, sf_dir):
    """Answers of occurrences applied to the questions."""
    o = _occ(spark, sf_dir, "question_id", "answer_status", "answer_letter").filter("answer_status in ('matched', 'annulled')")
    a = o.groupBy(_key("question_id").alias("id")).agg(F.min("answer_letter").alias("answer"), F.min(F.col("answer_status") == "annulled").alias("annulled"))
    return joins.apply_answers(table(spark, sf_dir, "questions").select("id"), a, _ONE).groupBy("new_status", "new_answer").agg(F.count("*").alias("n"))


def link_intervals(spark, sf_dir):
    """Question numbers inside the number ranges of each document's first questions."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null").select("id", "document_id", "question_number", "load_no")
    r = q.groupBy("document_id", "load_no").agg(F.min("question_number").alias("first"), F.max("question_number").alias("last"))
    return joins.in_interval(q.select("id", "document_id", "question_number"), r.withColumnRenamed("load_no", "range_load"), "document_id", "question_number", "first", "last").select("id", "range_load")


def link_interval_of_numbers(spark, sf_dir):
    """Closed interval of each document's numbers, null where they have gaps."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null").groupBy("document_id").agg(F.min("question_number").alias("a"), F.max("question_number").alias("b"), F.count_distinct("question_number").alias("c"))
    i = dates.closed_interval(F.col("a"), F.col("b"), F.col("c"))
    return q.select("document_id", i["first"].alias("first"), i["last"].alias("last"))


KEYWORDS = [("Saúde", "vacina"), ("Saúde", "pressão arterial"), ("Meio Ambiente", "caatinga"), ("Meio Ambiente", "lençol"), ("Informática", "rede sem fio"), ("Informática", "planilha"), ("Matemática", "raiz"), ("Matemática", "fração")]


def link_keywords(spark, sf_dir):
    """Taxonomy path of staged statements by keyword weight; ties and weak matches stay open."""
    s = table(spark, sf_dir, "question_staging").select("id", F.split(text.alnum(F.col("statement")), " ").alias("toks"))
    k = spark.createDataFrame([(p, " ".join(w.lower().translate(str.maketrans("áãçéêíóõôú", "aaceeiooou")).split())) for p, w in KEYWORDS], "path string, keyword string")
    return classify.keyword_match(s, k, 1).groupBy("path", "score").agg(F.count("*").alias("n"))


def link_headings(spark, sf_dir):
    """Heading to area by folded name."""
    a = table(spark, sf_dir, "subject_areas").select(F.col("area_code").alias("path"), text.alnum(F.col("area_name")).alias("heading_key"), F.size(F.split("area_name", " ")).alias("specificity"))
    q = questions(spark, sf_dir).select("id", F.col("discipline").alias("heading"))
    return classify.heading_match(q, a).groupBy("path").agg(F.count("*").alias("n"))


def link_alias(spark, sf_dir):
    """Organizations by short alias: selected, ambiguous or unknown."""
    q = questions(spark, sf_dir)
    names = q.filter("organization is not null").select(text.fold(F.col("organization")).alias("canonical")).distinct()
    a = names.select(F.regexp_replace("canonical", "^(prefeitura de|autarquia|camara de) ", "").alias("alias"), "canonical")
    s = table(spark, sf_dir, "question_staging").select("id", F.regexp_replace(text.fold(F.col("organization")), "^(prefeitura de|autarquia|camara de) ", "").alias("alias"))
    return joins.resolve_alias(s, a, ["alias"]).groupBy("outcome").agg(F.count("*").alias("n"))


def link_canonical_names(spark, sf_dir):
    q = questions(spark, sf_dir).filter("board is not null").select(F.regexp_extract(text.fold(F.col("board")), "^([a-z]+ ?[a-z]?)", 1).alias("alias"), text.fold(F.col("board")).alias("name"))
    return classify.canonical_names(q)


def link_grid_check(spark, sf_dir):
    """Numbers of the answer occurrences against the question numbers, per document."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null").select("document_id", F.col("question_number").alias("number"))
    o = _occ(spark, sf_dir, "document_id", "original_number").filter("document_id is not null").select("document_id", F.col("original_number").alias("number"))
    return joins.grid_check(q, o, ["document_id"], "number").groupBy("outcome").agg(F.count("*").alias("n"))


def link_paired_models(spark, sf_dir):
    """Wins, losses, ties and exact McNemar p of the models over the questions both answered."""
    s = windows.latest_per_key(table(spark, sf_dir, "desktop_answer_suggestions").select(_key("question_id").alias("item"), "model", "suggested_answer", "confidence", "created_at", "id"), ["item", "model"], ["created_at", "id"])
    q = questions(spark, sf_dir).select(F.col("id").alias("item"), "correct_answer").filter("correct_answer is not null")
    j = s.filter("model is not null").join(q, "item").select("item", "model", F.coalesce(F.col("suggested_answer") == F.col("correct_answer"), F.lit(False)).alias("ok"))
    return joins.paired(j, "item", "model", "ok").withColumn("p_value", F.round(stats.mcnemar_p(F.col("wins_a"), F.col("wins_b")), 6))


FIELDS = [
    linkage.Evidence("board", "q_board", "s_board", 12, True),
    linkage.Evidence("organization", "q_org", "s_org", 10),
    linkage.Evidence("role", "q_role", "s_role", 8),
    linkage.Evidence("year", "q_year", "s_year", 12, True),
]


def link_evidence(spark, sf_dir):
    """Stored questions linked to staged ones of the same statement by weighted evidence with a margin."""
    one = lambda c: F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), F.array(text.fold(c.cast("string")))).otherwise(F.array().cast("array<string>"))
    q = questions(spark, sf_dir).select("id", F.sha2(text.comparison_key(F.col("statement")), 256).alias("block"), one(F.col("board")).alias("q_board"), one(F.col("organization")).alias("q_org"), one(F.col("role")).alias("q_role"), one(F.col("year")).alias("q_year"))
    s = table(spark, sf_dir, "question_staging").select(F.col("id").alias("sid"), F.sha2(text.comparison_key(F.col("statement")), 256).alias("block"), one(F.col("board")).alias("s_board"), one(F.col("organization")).alias("s_org"), one(F.col("role_name")).alias("s_role"), one(F.col("exam_year")).alias("s_year"))
    pairs = linkage.assess(q.join(s, "block"), FIELDS)
    return linkage.decide(pairs, "id", "sid", 20, 8)


def link_unique_best(spark, sf_dir):
    """The document of most questions per discipline; equal counts are ambiguous."""
    q = questions(spark, sf_dir).filter("document_id is not null").groupBy("discipline", "document_id").agg(F.count("*").alias("n"))
    return linkage.unique_best(q, "discipline", "document_id", [F.desc("n")]).select("discipline", "n_best", "outcome")


def link_best_tier(spark, sf_dir):
    """Observations of a document by first non-empty tier: resolved, then anything else."""
    o = table(spark, sf_dir, "document_observations").filter("document_id is not null").select("id", "document_id", F.when(F.col("document_version_id").isNotNull(), 1).otherwise(2).alias("tier")).distinct()
    return joins.best_tier(o, "document_id", "tier").groupBy("tier").agg(F.count("*").alias("n"))


def link_precision(spark, sf_dir):
    """Documents with labels against documents of two kinds."""
    e = table(spark, sf_dir, "doc_labels").select("doc_id")
    f = table(spark, sf_dir, "documents").filter("doc_kind in ('aula', 'resumo')").select("doc_id")
    return sampling.precision_coverage(e, f, ["doc_id"])


def link_urls(spark, sf_dir):
    """Canonical source URLs of batches with host and signature test."""
    b = table(spark, sf_dir, "import_batches").select("id", "source_url")
    return b.select("id", urls.host(F.col("source_url")).alias("host"), urls.canonical(F.col("source_url")).alias("canonical"), F.coalesce(urls.is_signed(F.col("source_url")), F.lit(False)).alias("signed"), urls.in_allowlist(F.col("source_url"), ["example.com"]).alias("allowed"))


def set_union_keys(spark, sf_dir):
    q = table(spark, sf_dir, "questions").select(F.col("document_id")).filter("document_id is not null")
    return setops.union_keys(q, table(spark, sf_dir, "pages"), "document_id")


def set_difference(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("document_id").distinct()
    return setops.difference(p, table(spark, sf_dir, "questions").filter("document_id is not null"), ["document_id"])


def set_difference_sources(spark, sf_dir):
    """Documents of questions that the first load had not observed."""
    q = table(spark, sf_dir, "questions").filter("document_id is not null").select("document_id").distinct()
    seen = table(spark, sf_dir, "document_observations").filter("document_id is not null and load_no = 0")
    return setops.difference(q, seen, ["document_id"])


def set_intersection(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("document_id").distinct()
    return setops.intersection(p, table(spark, sf_dir, "questions").filter("document_id is not null"), ["document_id"])


def set_either_key(spark, sf_dir):
    """Batches kept in order unless their content or source digest was seen on a kept one."""
    b = table(spark, sf_dir, "import_batches").select("id", "model", "source_sha256", "content_sha256", F.date_format("imported_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    b = b.withColumn("model", F.coalesce("model", F.lit("(none)")))
    return setops.dedupe_either_key(b.withColumn("at", F.concat_ws("#", "at", "id")), "model", "at", "content_sha256", "source_sha256").select("id", "model")


def set_catalog(spark, sf_dir):
    return setops.merge_catalog(questions(spark, sf_dir).select("discipline", "matter", F.coalesce("board", F.lit("(none)")).alias("board")), ["discipline", "matter"], "board")


QUERIES = {k: v for k, v in globals().items() if k.startswith(("link_", "set_")) and callable(v)}

_O = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM question_occurrences) WHERE rn = 1)"


def _k(c):
    return f"nullif(trim(lower({c})), '')"


_LIST = "CASE WHEN {0} IS NOT NULL AND trim({0}::varchar) <> '' THEN {1} END"
ORACLE = {
    "link_left_chain": f"SELECT q.status, v.document_role, count(*) AS n FROM {_O} o LEFT JOIN questions q ON q.id = {_k('o.question_id')} LEFT JOIN document_versions v ON v.id = {_k('o.document_version_id')} GROUP BY 1, 2",
    "link_left_filtered": f"""WITH s AS (SELECT {_k('question_id')} AS qid, id, suggested_answer, is_official, row_number() OVER (PARTITION BY {_k('question_id')}, id ORDER BY created_at DESC) AS rn FROM desktop_answer_suggestions)
      SELECT q.id, min(s.suggested_answer) AS official_answer FROM questions q LEFT JOIN s ON s.qid = q.id AND s.rn = 1 AND s.is_official GROUP BY 1""",
    "link_exists": f"SELECT id, status FROM questions q WHERE EXISTS (SELECT 1 FROM question_occurrences o WHERE {_k('o.question_id')} = q.id)",
    "link_not_exists": """SELECT DISTINCT document_id FROM questions d WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM questions r WHERE r.document_id = d.document_id AND lower(trim(r.status)) = 'rejected')
      AND EXISTS (SELECT 1 FROM question_occurrences o WHERE o.document_id = d.document_id)""",
    "link_latest_value": f"""SELECT q.id, s.a AS suggested_answer FROM questions q LEFT JOIN (SELECT {_k('question_id')} AS id, arg_max_null(suggested_answer, (created_at, coalesce(suggested_answer, ''))) AS a FROM desktop_answer_suggestions GROUP BY 1) s USING (id)""",
    "link_gathered": f"SELECT contest_id, coalesce(array_to_string(list_sort(list(DISTINCT booklet_id)), '|'), '') AS booklets FROM {_O} WHERE contest_id IS NOT NULL GROUP BY 1",
    "link_either_key": "SELECT DISTINCT id, document_id, document_version_id FROM document_observations o WHERE EXISTS (SELECT 1 FROM document_versions v WHERE v.deleted_at IS NOT NULL AND (v.id = o.document_id OR v.id = o.document_version_id))",
    "link_compare_loads": """WITH q AS (SELECT document_id, question_number, fingerprint, load_no >= 4 AS late, row_number() OVER (PARTITION BY document_id, question_number, load_no >= 4 ORDER BY updated_at DESC, id DESC) AS rn
      FROM questions WHERE document_id IS NOT NULL AND question_number IS NOT NULL),
      j AS (SELECT a.fingerprint AS x, b.fingerprint AS y, a.document_id AS da, b.document_id AS db FROM (SELECT * FROM q WHERE NOT late AND rn = 1) a FULL JOIN (SELECT * FROM q WHERE late AND rn = 1) b ON a.document_id = b.document_id AND a.question_number = b.question_number)
      SELECT CASE WHEN da IS NULL THEN 'added' WHEN db IS NULL THEN 'removed' WHEN x IS NOT DISTINCT FROM y THEN 'unchanged' ELSE 'changed' END AS change, count(*) AS n FROM j GROUP BY 1""",
    "link_null_safe": f"""WITH w AS (SELECT document_id, document_version_id AS w, row_number() OVER (PARTITION BY document_id ORDER BY last_seen_at DESC, id DESC) AS rn FROM document_observations WHERE document_id IS NOT NULL)
      SELECT count(*) AS n_differ FROM {_O} o JOIN w USING (document_id) WHERE w.rn = 1 AND {_k('o.document_version_id')} IS DISTINCT FROM lower(trim(w.w))""",
    "link_apply_answers": f"""WITH a AS (SELECT {_k('question_id')} AS id, min(answer_letter) AS answer, bool_and(answer_status = 'annulled') AS annulled FROM {_O} WHERE answer_status IN ('matched', 'annulled') GROUP BY 1),
      j AS (SELECT q.id, a.id AS hit, answer, annulled FROM questions q LEFT JOIN a ON a.id = q.id)
      SELECT CASE WHEN hit IS NULL THEN 'missing' WHEN annulled THEN 'annulled' ELSE 'matched' END AS new_status, CASE WHEN NOT annulled THEN answer END AS new_answer, count(*) AS n FROM j GROUP BY 1, 2""",
    "link_intervals": """WITH r AS (SELECT document_id, load_no, min(question_number) AS a, max(question_number) AS b FROM questions WHERE document_id IS NOT NULL GROUP BY 1, 2)
      SELECT q.id, r.load_no AS range_load FROM questions q JOIN r ON r.document_id = q.document_id AND q.question_number BETWEEN r.a AND r.b""",
    "link_interval_of_numbers": """WITH g AS (SELECT document_id, min(question_number) AS a, max(question_number) AS b, count(DISTINCT question_number) AS c FROM questions WHERE document_id IS NOT NULL GROUP BY 1)
      SELECT document_id, CASE WHEN b - a + 1 = c THEN a END AS first, CASE WHEN b - a + 1 = c THEN b END AS last FROM g""",
    "link_keywords": f"""WITH k(path, keyword) AS (VALUES {', '.join(f"('{p}', {alnum(chr(39) + w + chr(39))})" for p, w in KEYWORDS)}),
      h AS (SELECT s.id, k.path, sum(least(3, len(string_split(k.keyword, ' ')))) AS score FROM question_staging s JOIN k ON contains(' ' || {alnum('s.statement')} || ' ', ' ' || k.keyword || ' ') GROUP BY 1, 2),
      b AS (SELECT id, max(score) AS top FROM h GROUP BY 1), t AS (SELECT h.id, b.top, count(*) AS n_top, max(path) AS path FROM h JOIN b ON h.id = b.id AND h.score = b.top GROUP BY 1, 2)
      SELECT CASE WHEN n_top = 1 AND top >= 1 THEN path END AS path, top::bigint AS score, count(*) AS n FROM t GROUP BY 1, 2""",
    "link_headings": f"WITH {QUESTIONS} SELECT a.area_code AS path, count(*) AS n FROM q JOIN subject_areas a ON {alnum('q.discipline')} = {alnum('a.area_name')} GROUP BY 1",
    "link_alias": f"""WITH {QUESTIONS}, a AS (SELECT regexp_replace(c, '^(prefeitura de|autarquia|camara de) ', '') AS alias, count(DISTINCT c) AS n FROM (SELECT DISTINCT {fold('organization')} AS c FROM q WHERE organization IS NOT NULL) GROUP BY 1)
      SELECT CASE WHEN a.n IS NULL THEN 'unknown' WHEN a.n > 1 THEN 'ambiguous' ELSE 'selected' END AS outcome, count(*) AS n
      FROM question_staging s LEFT JOIN a ON a.alias = regexp_replace({fold('s.organization')}, '^(prefeitura de|autarquia|camara de) ', '') GROUP BY 1""",
    "link_canonical_names": f"WITH {QUESTIONS} SELECT regexp_extract({fold('board')}, '^([a-z]+ ?[a-z]?)', 1) AS alias, min({fold('board')}) AS name FROM q WHERE board IS NOT NULL GROUP BY 1 HAVING count(DISTINCT {fold('board')}) = 1",
    "link_grid_check": f"""WITH e AS (SELECT DISTINCT document_id, question_number AS n FROM questions WHERE document_id IS NOT NULL), f AS (SELECT DISTINCT document_id, original_number AS n FROM {_O} WHERE document_id IS NOT NULL),
      j AS (SELECT coalesce(e.document_id, f.document_id) AS d, e.document_id AS a, f.document_id AS b FROM e FULL JOIN f ON e.document_id = f.document_id AND e.n = f.n),
      g AS (SELECT d, count(*) FILTER (a IS NULL) AS x, count(*) FILTER (b IS NULL) AS m FROM j GROUP BY 1)
      SELECT CASE WHEN x > 0 THEN 'conflict' WHEN m > 0 THEN 'incomplete' ELSE 'compatible' END AS outcome, count(*) AS n FROM g GROUP BY 1""",
    "link_unique_best": f"""WITH {QUESTIONS}, g AS (SELECT discipline, document_id, count(*) AS n FROM q WHERE document_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY discipline ORDER BY n DESC) AS rk FROM g)
      SELECT discipline, count(*) AS n_best, CASE WHEN count(*) = 1 THEN 'selected' ELSE 'ambiguous' END AS outcome FROM r WHERE rk = 1 GROUP BY 1""",
    "link_best_tier": """WITH o AS (SELECT DISTINCT id, document_id, CASE WHEN document_version_id IS NOT NULL THEN 1 ELSE 2 END AS tier FROM document_observations WHERE document_id IS NOT NULL),
      t AS (SELECT *, min(tier) OVER (PARTITION BY document_id) AS best FROM o) SELECT tier, count(*) AS n FROM t WHERE tier = best GROUP BY 1""",
    "link_precision": """WITH e AS (SELECT DISTINCT doc_id FROM doc_labels), f AS (SELECT DISTINCT doc_id FROM documents WHERE doc_kind IN ('aula', 'resumo')),
      c AS (SELECT (SELECT count(*) FROM e) AS n_expected, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM e SEMI JOIN f USING (doc_id)) AS n_matched)
      SELECT *, round(n_matched::double / n_found, 6) AS precision, round(n_matched::double / n_expected, 6) AS coverage FROM c""",
    "link_evidence": f"""WITH {QUESTIONS}, a AS (SELECT id, sha256(regexp_replace(strip_accents(replace(lower(statement), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS block, {', '.join(_LIST.format(c, fold(c + '::varchar')) + f' AS q{n}' for n, c in enumerate(['board', 'organization', 'role', 'year']))} FROM q),
      b AS (SELECT id AS sid, sha256(regexp_replace(strip_accents(replace(lower(statement), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS block, {', '.join(_LIST.format(c, fold(c + '::varchar')) + f' AS s{n}' for n, c in enumerate(['board', 'organization', 'role_name', 'exam_year']))} FROM question_staging),
      p AS (SELECT id, sid, CASE WHEN {' OR '.join(f'coalesce(q{n} <> s{n}, false)' for n in range(4))} THEN 'conflict' WHEN q0 IS NULL OR s0 IS NULL OR q3 IS NULL OR s3 IS NULL THEN 'incomplete' ELSE 'comparable' END AS state,
        {' + '.join(f'CASE WHEN q{n} = s{n} THEN {w} ELSE 0 END' for n, w in enumerate((12, 10, 8, 12)))} AS score FROM a JOIN b USING (block)),
      r AS (SELECT *, row_number() OVER (PARTITION BY id, state ORDER BY score DESC, sid DESC) AS rk FROM p),
      g AS (SELECT id, count(*) AS n_candidates, count(*) FILTER (state = 'comparable') AS n_comparable, count(*) FILTER (state = 'incomplete') AS ni, max(score) FILTER (state = 'comparable' AND rk = 1) AS s1, max(sid) FILTER (state = 'comparable' AND rk = 1) AS c1, max(score) FILTER (state = 'comparable' AND rk = 2) AS s2 FROM r GROUP BY 1),
      o AS (SELECT *, CASE WHEN n_comparable = 0 THEN CASE WHEN ni > 0 THEN 'incomplete' ELSE 'conflict' END WHEN s1 < 20 THEN 'below_minimum' WHEN s1 - coalesce(s2, -1000000) < 8 THEN 'ambiguous' ELSE 'selected' END AS outcome FROM g)
      SELECT id, n_candidates, n_comparable, outcome, s1 AS best_score, CASE WHEN outcome = 'selected' THEN c1 END AS chosen FROM o""",
    "link_paired_models": f"""WITH {QUESTIONS}, s AS (SELECT * FROM (SELECT nullif(trim(lower(question_id)), '') AS item, model, suggested_answer, row_number() OVER (PARTITION BY nullif(trim(lower(question_id)), ''), model ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM desktop_answer_suggestions) WHERE rn = 1 AND model IS NOT NULL),
      j AS (SELECT item, model, coalesce(suggested_answer = correct_answer, false) AS ok FROM s JOIN q ON q.id = s.item WHERE correct_answer IS NOT NULL),
      p AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n_items, count(*) FILTER (a.ok AND NOT b.ok) AS wins_a, count(*) FILTER (b.ok AND NOT a.ok) AS wins_b, count(*) FILTER (a.ok = b.ok) AS ties FROM j a JOIN j b ON a.item = b.item AND a.model < b.model GROUP BY 1, 2)
      SELECT *, round(least(1.0::double, 2 * list_sum(list_transform(range(0, least(wins_a, wins_b) + 1), lambda i: exp(lgamma(wins_a + wins_b + 1) - lgamma(i + 1) - lgamma(wins_a + wins_b - i + 1) - (wins_a + wins_b) * ln(2.0))))), 6) AS p_value FROM p""",
    "set_union_keys": "SELECT document_id FROM questions WHERE document_id IS NOT NULL UNION SELECT document_id FROM pages",
    "set_difference": "SELECT document_id FROM pages EXCEPT SELECT document_id FROM questions",
    "set_difference_sources": "SELECT document_id FROM questions WHERE document_id IS NOT NULL EXCEPT SELECT document_id FROM document_observations WHERE load_no = 0",
    "set_intersection": "SELECT document_id FROM pages INTERSECT SELECT document_id FROM questions",
    "set_catalog": f"WITH {QUESTIONS} SELECT discipline, matter, array_to_string(list_sort(list(DISTINCT coalesce(board, '(none)'))), '|') AS provenances, count(*) AS n_rows FROM q GROUP BY 1, 2",
}
