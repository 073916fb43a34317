"""Queries over documents and pages: text functions, duplicates, triage, grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.functions import dates, hashing, text
from lauda.operators import classify, dedup, facets, hyphens, parsers, quality, sampling
from lauda.operators.windows import with_neighbours
from lauda.session import table
from lauda.sqltext import WS, alnum, fold, fold_keep, percent, squeeze, wilson


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_exact_dedup(spark, sf_dir):
    """One row per folded text: the smallest doc_id, the number of copies, the content hash."""
    d = _docs(spark, sf_dir).select("doc_id", F.sha2(text.fold(F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))
    return d.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def doc_duplicate_counts(spark, sf_dir):
    return facets.duplicate_counts(_docs(spark, sf_dir), F.sha2(text.fold(F.coalesce("text", F.lit(""))), 256))


def doc_claims(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return dedup.claims(d, F.sha2(F.coalesce("text", F.lit("")), 256), "collected_at", "source")


def doc_fold_filter(spark, sf_dir):
    """Accent- and case-insensitive equality on source plus full-text containment."""
    from lauda.operators.filters import fold_equals, full_text

    d = _docs(spark, sf_dir)
    return d.filter(fold_equals(F.col("doc_kind"), ["Notícia", "AULA"]) & full_text("CONSTITUIÇÃO", F.col("text"))).select("doc_id", "doc_kind", "source")


def doc_normal_forms(spark, sf_dir):
    """Hashes of the normal forms, so that whole texts are compared."""
    c = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.sha2(text.alnum(c), 256).alias("alnum"),
        F.sha2(text.comparison_key(c), 256).alias("key"),
        text.slug(F.substring(c, 1, 60), 40).alias("slug"),
        F.size(text.words(c)).alias("n_words"),
    )


def doc_period_years(spark, sf_dir):
    """Years named in each text and whether the document falls in a period (unknown passes)."""
    y = dates.years(F.coalesce("text", F.lit("")))
    d = _docs(spark, sf_dir).select("doc_id", F.array_join(y, ",").alias("years"), dates.only_year(F.coalesce("text", F.lit(""))).alias("only_year"))
    return d.withColumn("in_period", F.col("only_year").isNull() | F.col("only_year").between(2000, 2015))


def doc_periods(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.year("collected_at"), F.lit("/"), F.when(F.month("collected_at") <= 6, 1).otherwise(2)).alias("s")).select(
        "doc_id", dates.periods(F.col("s"))[0]["year"].alias("year"), dates.periods(F.col("s"))[0]["semester"].alias("semester")
    )


def doc_triage_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_kind", classify.triage(F.concat_ws(" ", "doc_kind", "source"), F.col("text")).alias("t"))
    return d.groupBy("doc_kind", F.col("t.decision").alias("decision"), F.col("t.confidence").alias("confidence")).agg(F.count("*").alias("n"))


def page_text_triage(spark, sf_dir):
    """Pages whose text layer needs recognition, per status."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy("status").agg(F.count("*").alias("n_pages"), F.count_if(quality.needs_ocr(F.col("text"))).alias("n_needs_ocr"))


def page_quality(spark, sf_dir):
    """Grade of every page's text."""
    q = quality.ocr_quality(F.col("text"), F.col("confidence"))
    return table(spark, sf_dir, "pages").select("document_id", "page_number", q.alias("q")).select("document_id", "page_number", F.round("q.score", 3).alias("score"), "q.usable", "q.reason")


def page_integrity(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.explode(quality.integrity_issues(F.coalesce("text", F.lit("")))).alias("issue"))
    return p.groupBy("issue").agg(F.count("*").alias("n_pages"))


def page_needs_ocr(spark, sf_dir):
    from lauda.sources.readers import needs_ocr

    return needs_ocr(table(spark, sf_dir, "pages").select(F.col("document_id").alias("path"), "text"))


def page_repeated_heads(spark, sf_dir):
    """First lines that stand on more than one page of a document, without their page number."""
    from lauda.operators.windows import repeated_on_pages

    p = table(spark, sf_dir, "pages").filter("text is not null").select("document_id", "page_number", text.header_token(F.substring_index("text", "\n", 1)).alias("token"))
    return repeated_on_pages(p.filter("token <> ''"), "document_id", "page_number", "token")


def page_caps_headings(spark, sf_dir):
    """Lines set all in capitals, per document."""
    p = table(spark, sf_dir, "pages").filter("text is not null").select("document_id", F.explode(F.split("text", "\n")).alias("line"))
    return p.filter(text.is_caps_heading(F.col("line"))).groupBy("document_id").agg(F.count("*").alias("n_headings"))


def page_running_block(spark, sf_dir):
    """How many lines of each page stand under the last QUESTÃO heading above them."""
    from lauda.operators.windows import running_block

    p = table(spark, sf_dir, "pages").filter("text is not null").select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heading = F.when(F.col("line").rlike(r"^QUESTÃO [0-9]+$"), F.regexp_extract("line", "([0-9]+)", 1).cast("int"))
    rows = running_block(p, ["document_id", "page_number"], "pos", heading)
    return rows.groupBy("document_id", "page_number", "block").agg(F.count("*").alias("n_lines"))


def page_questions(spark, sf_dir):
    """Questions read from page text."""
    p = table(spark, sf_dir, "pages").select(F.concat_ws("#", "document_id", "page_number").alias("page"), "text")
    return parsers.expand(p, "page", "text", parsers.questions, parsers.QUESTION_SCHEMA)


def page_hyphen_repair(spark, sf_dir):
    """Line-end cuts joined where the spelling of the whole document confirms it."""
    p = table(spark, sf_dir, "pages").select("document_id", "page_number", "text")
    return hyphens.repaired(p, ["document_id", "page_number"], "document_id", "text").select("document_id", "page_number", "n_joined")


def doc_chunks(spark, sf_dir):
    """Chunks of at most 4,000 characters with an overlap of 200."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc"), "text")
    out = parsers.expand(d, "doc", "text", lambda t: parsers.chunks(t, 4000, 200), parsers.CHUNK_SCHEMA)
    return out.select("doc", "chunk_no", "start", F.length("chunk").alias("n_chars"))


def doc_label_wilson(spark, sf_dir):
    """Share of labelled documents per kind whose area is one of two, with its Wilson interval."""
    j = table(spark, sf_dir, "doc_labels").join(_docs(spark, sf_dir).select("doc_id", "doc_kind"), "doc_id")
    return sampling.accuracy_table(j, ["doc_kind"], F.col("area_code").isin("matematica", "pedagogia"))


def doc_stratified_sample(spark, sf_dir):
    return sampling.stratified(_docs(spark, sf_dir).select("doc_id", "doc_kind"), "doc_kind", "doc_id", 60, "lauda")


def doc_coverage_sample(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "doc_kind", "lang")
    return sampling.coverage_first(d, "doc_id", {"kind": F.col("doc_kind"), "lang": F.col("lang")}, 50, "lauda")


def doc_missing_patterns(spark, sf_dir):
    return sampling.missing_patterns(_docs(spark, sf_dir), ["text", "lang", "source", "collected_at"])


def doc_token_match(spark, sf_dir):
    """Evaluation items and documents of one source that share identifier-like title tokens."""
    d = _docs(spark, sf_dir).select("doc_id", text.tokens(F.coalesce("source", F.lit(""))).alias("a"), text.tokens(F.concat_ws(" ", "source", "doc_kind")).alias("b"))
    return d.select("doc_id", F.round(text.token_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), text.tokens_match(F.col("a"), F.col("b")).alias("matches"), text.identifier_evidence(F.col("b")).alias("evidence"))


def doc_sequence_ratio(spark, sf_dir):
    """Ratcliff/Obershelp ratio between each item and the next one."""
    e = with_neighbours(table(spark, sf_dir, "eval_items").select("item_id", "text"), [], "item_id", ["text"])
    return e.select("item_id", F.round(dedup.sequence_ratio("text", "next_text"), 6).alias("ratio"))


def doc_hash_identity(spark, sf_dir):
    """Canonical JSON hash and name-based UUID of each document's identity."""
    d = _docs(spark, sf_dir)
    return d.select("doc_id", hashing.sha256_json(doc_id=F.col("doc_id"), lang=F.col("lang"), source=F.col("source")).alias("sha"), hashing.uuid5(hashing.NAMESPACE_URL, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"))


def doc_token_cost(spark, sf_dir):
    from lauda.functions.stats import token_cost

    n, cost = token_cost(F.coalesce("text", F.lit("")), 0.000002)
    return _docs(spark, sf_dir).select("doc_id", n.alias("n_tokens"), F.round(cost, 8).alias("cost"))


def doc_artifact_cut(spark, sf_dir):
    """Text before the first artifact line and the kinds of artifact met."""
    kept, codes = text.cut_artifacts(F.coalesce("text", F.lit("")), ["^Indique o que", "^Com base no texto"])
    return _docs(spark, sf_dir).select("doc_id", F.length(kept).alias("n_kept"), F.array_join(codes, ",").alias("codes"))


QUERIES = {k: v for k, v in globals().items() if k.startswith(("doc_", "page_")) and callable(v)}

_T = "coalesce(text, '')"
_CLEAN = "regexp_replace(replace(coalesce(text, ''), chr(0), ''), '^\\s+|\\s+$', '', 'g')"
_TRI = f"{fold_keep('coalesce(text, chr(32))')}"
_NAME = squeeze(f"replace(replace({fold_keep('''concat_ws(' ', doc_kind, source)''')}, '_', ' '), '-', ' ')")


def _n(c, pattern):
    return f"len(regexp_extract_all({c}, '{pattern}'))"


def _hits(c, markers):
    return "(" + " + ".join(f"(contains({c}, '{m}'))::int" for m in markers) + ")"


def _tok(c):
    stop = ", ".join(f"'{w}'" for w in text.STOP_TOKENS)
    return f"list_distinct(list_filter(regexp_extract_all({fold_keep(c)}, '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN ({stop})))"


ORACLE = {
    "doc_exact_dedup": f"SELECT sha256({fold(_T)}) AS fingerprint, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "doc_duplicate_counts": f"SELECT sum(c)::bigint AS n_rows, count(*) AS n_unique, (sum(c) - count(*))::bigint AS n_surplus, count(*) FILTER (c > 1) AS n_repeated FROM (SELECT count(*) AS c FROM documents GROUP BY sha256({fold(_T)}))",
    "doc_claims": "SELECT sha256(coalesce(text, '')) AS digest, min(collected_at) AS first_seen, max(collected_at) AS last_seen, count(*) AS n_sightings, count(DISTINCT source) AS n_origins FROM documents GROUP BY 1",
    "doc_fold_filter": f"SELECT doc_id, doc_kind, source FROM documents WHERE {fold('doc_kind')} IN ('noticia', 'aula') AND contains({fold('text')}, 'constituicao')",
    "doc_normal_forms": f"""SELECT doc_id, sha256({alnum(_T)}) AS alnum, sha256(regexp_replace({fold_keep(_T)}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key,
      rtrim(substring(replace({alnum(f'substring({_T}, 1, 60)')}, ' ', '-'), 1, 40), '-') AS slug, len(regexp_extract_all({fold_keep(_T)}, '[\\p{{L}}\\p{{N}}]+')) AS n_words FROM documents""",
    "doc_period_years": f"""
WITH y AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({_T}, '[0-9]+'), lambda x: regexp_full_match(x, '(19|20)[0-9][0-9]')), lambda x: x::int))) AS ys FROM documents)
SELECT doc_id, array_to_string(ys, ',') AS years, CASE WHEN len(ys) = 1 THEN ys[1] END AS only_year, (len(ys) <> 1 OR ys[1] BETWEEN 2000 AND 2015) AS in_period FROM y""",
    "doc_periods": "SELECT doc_id, year(collected_at)::int AS year, CASE WHEN collected_at IS NULL THEN NULL WHEN month(collected_at) <= 6 THEN 1 ELSE 2 END AS semester FROM documents",
    "doc_triage_counts": f"""
WITH t AS (SELECT doc_kind, {_NAME} AS n, replace({_TRI}, '_', ' ') AS c FROM documents),
m AS (SELECT *, {_n('c', '(?m)^[ \\t]*(?:questao[ \\t]*)?[0-9]{1,3}[ \\t]*[-.:)][ \\t]*[a-e][ \\t]*$')} AS answers,
  {_n('c', '(?m)^[ \\t]*(?:questao|q)[ \\t]*[ºo.]?[ \\t]*[0-9]{1,3}\\b')} AS headers,
  {_n('c', '(?m)^[ \\t]*(?:\\([a-e]\\)|[a-e][ \\t]*[).:-])[ \\t]+[^ \\t\\n]+')} AS alts,
  {_n('c', '(?m)^[ \\t]*[0-9]{1,3}[ \\t]*$')} AS bare, {_n('c', '(?m)^[ \\t]*[0-9]{1,3}[ \\t]+[^ \\t\\n]+')} AS items,
  {_hits('n', classify.KEY_NAMES)} > 0 AS key_name, {_hits('n', classify.IRRELEVANT)} AS in_name, {_hits('c', classify.IRRELEVANT)} AS in_text,
  {_hits("n || chr(10) || c", classify.ADMINISTRATIVE)} AS admin FROM t),
d AS (SELECT *, (headers >= 1 AND alts >= 2) OR (bare >= 2 AND alts >= 4) OR (contains(c, 'caso julgue o item certo') AND contains(c, 'caso julgue o item errado') AND items >= 3) AS exam,
  (in_name > 0 AND (in_text > 0 OR admin > 0)) OR (in_text >= 2 AND admin > 0) AS other FROM m)
SELECT doc_kind, CASE WHEN key_name OR answers >= 3 THEN 'answer_key' WHEN exam THEN 'exam' WHEN other THEN 'other' ELSE 'review' END AS decision,
  round(CASE WHEN key_name AND answers >= 3 THEN 0.98 WHEN key_name OR answers >= 3 THEN 0.9 WHEN exam THEN 0.96
    WHEN other THEN least(0.99, 0.86 + 0.03 * least(4, least(3, in_name) + least(3, in_text) + least(2, admin))) ELSE 0.5 END::double, 2) AS confidence, count(*) AS n
FROM d GROUP BY ALL""",
    "page_text_triage": f"""
WITH c AS (SELECT status, text IS NULL AS none, {_CLEAN} AS clean FROM pages), v AS (SELECT *, regexp_replace(clean, '\\s', '', 'g') AS visible FROM c)
SELECT status, count(*) AS n_pages, count(*) FILTER (none OR length(clean) < 20 OR length(regexp_replace(visible, '[\\p{{Cc}}\\p{{Cf}}\\p{{Co}}]', '', 'g')) < 0.9 * length(visible)
  OR length(regexp_replace(visible, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 8) AS n_needs_ocr FROM v GROUP BY status""",
    "page_integrity": """
WITH p AS (SELECT coalesce(text, '') AS t FROM pages)
SELECT issue, count(*) AS n_pages FROM (
  SELECT unnest(list_filter([CASE WHEN regexp_matches(t, '[\\x{E000}-\\x{F8FF}]') THEN 'private_glyphs' END, CASE WHEN contains(t, chr(65533)) THEN 'replacement_character' END,
    CASE WHEN regexp_matches(t, '(?im)^\\s*p[áa]gina\\s+[0-9]+(\\s+de\\s+[0-9]+)?\\s*$') THEN 'page_bleed' END], lambda x: x IS NOT NULL)) AS issue FROM p) GROUP BY issue""",
    "page_needs_ocr": "SELECT document_id AS path, count(*) AS n_pages, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) AS n_text, count(*) FILTER (length(trim(coalesce(text, ''))) > 0) < greatest(1.0, count(*) / 2.0) AS needs_ocr FROM pages GROUP BY 1",
    "doc_hash_identity": """
WITH h AS (SELECT doc_id, sha256('{"doc_id":' || coalesce(doc_id::varchar, 'null') || ',"lang":' || coalesce(to_json(lang)::varchar, 'null') || ',"source":' || coalesce(to_json(source)::varchar, 'null') || '}') AS sha,
  sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id::varchar)) AS h FROM documents)
SELECT doc_id, sha, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ((instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1)::int, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h""",
    "doc_chunks": """
WITH RECURSIVE c AS (
  SELECT doc_id, text, 1 AS chunk_no, 0 AS start, 0 AS stop, true AS fresh FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, CASE WHEN fresh THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN fresh THEN start ELSE greatest(stop - 200, start + 1) END,
    CASE WHEN fresh THEN CASE WHEN start + 4000 >= length(text) THEN length(text)
      WHEN contains(substr(text, start + 3001, 1000), chr(10)) THEN start + 4001 - instr(reverse(substr(text, start + 3001, 1000)), chr(10)) ELSE start + 4000 END ELSE stop END, NOT fresh
  FROM c WHERE fresh OR stop < length(text))
SELECT doc_id::varchar AS doc, chunk_no::int AS chunk_no, start::int AS start, (stop - start)::int AS n_chars FROM c WHERE NOT fresh""",
    "page_hyphen_repair": """
WITH l AS (SELECT document_id, page_number, text, string_split(text, chr(10)) AS ls FROM pages WHERE text IS NOT NULL),
n AS (SELECT document_id, page_number, ls, unnest(range(1, len(ls))) AS line_no FROM l),
cuts AS (SELECT document_id, page_number, line_no, regexp_extract(ls[line_no], '(\\p{L}{2,})([-\\x{AD}])[ \\t\\r]*$', 1) AS head, regexp_extract(ls[line_no], '(\\p{L}{2,})([-\\x{AD}])[ \\t\\r]*$', 2) AS mark,
  regexp_extract(ls[line_no + 1], '^[ \\t]*(\\p{L}{2,})', 1) AS tail FROM n WHERE regexp_matches(ls[line_no], '(\\p{L}{2,})([-\\x{AD}])[ \\t\\r]*$') AND regexp_matches(ls[line_no + 1], '^[ \\t]*\\p{Ll}\\p{L}')),
words AS (SELECT document_id, w FROM (SELECT document_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_-]+')) AS w FROM l) WHERE regexp_full_match(w, '\\p{L}+(-\\p{L}+)*')
  UNION SELECT document_id, lower(head || tail) FROM cuts WHERE mark = chr(173)),
j AS (SELECT DISTINCT document_id, page_number, line_no FROM cuts c
  WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.document_id IS NOT DISTINCT FROM c.document_id AND w.w = lower(head || '-' || tail))
    AND (mark = chr(173) OR EXISTS (SELECT 1 FROM words w WHERE w.document_id IS NOT DISTINCT FROM c.document_id AND w.w = lower(head || tail)))),
k AS (SELECT document_id, page_number, count(*) AS c FROM j GROUP BY ALL)
SELECT p.document_id, p.page_number, coalesce(k.c, 0)::int AS n_joined FROM pages p LEFT JOIN k ON p.document_id IS NOT DISTINCT FROM k.document_id AND p.page_number IS NOT DISTINCT FROM k.page_number""",
    "page_repeated_heads": f"""SELECT document_id, token, n_pages FROM (SELECT document_id, regexp_replace({fold("split_part(text, chr(10), 1)")}, '\\s*[0-9]+\\s*$', '') AS token, count(DISTINCT page_number) AS n_pages
      FROM pages WHERE text IS NOT NULL GROUP BY ALL) WHERE token <> '' AND n_pages > 1""",
    "page_caps_headings": f"""WITH l AS (SELECT document_id, {squeeze("unnest(string_split(text, chr(10)))")} AS t FROM pages WHERE text IS NOT NULL)
SELECT document_id, count(*) AS n_headings FROM l WHERE length(t) <= 72 AND t = upper(t) AND t <> lower(t) AND len(string_split(t, ' ')) >= 2 GROUP BY 1""",
    "page_running_block": """
WITH l AS (SELECT document_id, page_number, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM pages WHERE text IS NOT NULL),
b AS (SELECT *, last_value(CASE WHEN regexp_full_match(line, 'QUESTÃO [0-9]+') THEN regexp_extract(line, '([0-9]+)', 1)::int END IGNORE NULLS) OVER (PARTITION BY document_id, page_number ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM l)
SELECT document_id, page_number, block, count(*) AS n_lines FROM b GROUP BY ALL""",
    "doc_label_wilson": f"""
WITH t AS (SELECT doc_kind, count(*) FILTER (area_code IN ('matematica', 'pedagogia')) AS n_correct, count(*) AS n_total FROM doc_labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, {percent('n_correct', 'n_total')} AS accuracy, {wilson('n_correct', 'n_total', True)} AS ci_low, {wilson('n_correct', 'n_total', False)} AS ci_high FROM t""",
    "doc_stratified_sample": """
WITH s AS (SELECT doc_kind, count(*) AS size FROM documents GROUP BY 1), x AS (SELECT *, size * 60 / sum(size) OVER ()::double AS exact FROM s),
f AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, size DESC, doc_kind) AS rk, 60 - sum(floor(exact)) OVER () AS seats_left FROM x),
seats AS (SELECT doc_kind, fl + (rk <= seats_left)::int AS share FROM f),
r AS (SELECT doc_id, doc_kind, row_number() OVER (PARTITION BY doc_kind ORDER BY sha256('lauda' || doc_id::varchar), doc_id) AS n FROM documents)
SELECT doc_kind, doc_id FROM r JOIN seats USING (doc_kind) WHERE n <= share""",
    "doc_coverage_sample": """
WITH d AS (SELECT doc_id, coalesce(doc_kind, '(none)') AS kind, coalesce(lang, '(none)') AS lang, sha256('lauda' || doc_id::varchar) AS h FROM documents),
e AS (SELECT doc_id, h, 'kind' AS dim, kind AS val FROM d UNION ALL SELECT doc_id, h, 'lang', lang FROM d),
cover AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY dim, val ORDER BY h, doc_id) AS rn FROM e) WHERE rn = 1),
b AS (SELECT d.doc_id, d.h, CASE WHEN c.doc_id IS NOT NULL THEN 1 ELSE 2 END AS phase FROM d LEFT JOIN cover c USING (doc_id)),
n AS (SELECT *, row_number() OVER (ORDER BY phase, h, doc_id) AS rn FROM b)
SELECT doc_id, phase FROM n WHERE phase = 1 OR rn <= 50""",
    "doc_missing_patterns": "SELECT array_to_string(list_filter([CASE WHEN text IS NULL THEN 'text' END, CASE WHEN lang IS NULL THEN 'lang' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN collected_at IS NULL THEN 'collected_at' END], lambda x: x IS NOT NULL), ',') AS missing, count(*) AS n FROM documents GROUP BY 1",
    "doc_token_cost": "SELECT doc_id, greatest(1, ceil(strlen(coalesce(text, '')) / 3.0))::int AS n_tokens, round(greatest(1, ceil(strlen(coalesce(text, '')) / 3.0))::int * 0.000002::double, 8) AS cost FROM documents",
    "doc_token_match": f"""
WITH t AS (SELECT doc_id, {_tok("coalesce(source, '')")} AS a, {_tok("concat_ws(' ', source, doc_kind)")} AS b FROM documents)
SELECT doc_id, round(CASE WHEN len(list_distinct(a || b)) > 0 THEN len(list_intersect(a, b))::double / len(list_distinct(a || b)) END, 6) AS jaccard,
  coalesce(len(list_intersect(a, b)) >= 2 AND (len(list_intersect(a, b))::double / nullif(len(list_distinct(a || b)), 0)) >= 0.55, CASE WHEN len(list_intersect(a, b)) < 2 THEN false END) AS matches,
  least(8, len(list_filter(b, lambda x: regexp_matches(x, '[0-9]'))))::int AS evidence FROM t""",
    "doc_artifact_cut": """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: regexp_matches(x, '^Indique o que')) AS h1, list_transform(ls, lambda x: regexp_matches(x, '^Com base no texto')) AS h2 FROM l),
f AS (SELECT *, least(coalesce(list_position(h1, true), len(ls) + 1), coalesce(list_position(h2, true), len(ls) + 1)) AS k FROM h)
SELECT doc_id, length(rtrim(array_to_string(ls[1:k - 1], chr(10)), ' '))::int AS n_kept, array_to_string(list_filter([CASE WHEN list_contains(h1, true) THEN 1 END, CASE WHEN list_contains(h2, true) THEN 2 END], lambda x: x IS NOT NULL), ',') AS codes FROM f""",
}
