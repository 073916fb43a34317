import datetime
import gzip
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lauda import queries_state
from lauda.operators import classify, dedup, facets, filters, hyphens, joins, linkage, parsers, quality, setops, state, windows
from lauda.plans.pipeline import Pipeline, checked_suggestions
from lauda.sources import readers, sinks

T = datetime.datetime


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_answer_key_layouts():
    assert parsers.answer_key("1 - B\n2) ANULADA\n3. D") == [(1, "B", False), (2, None, True), (3, "D", False)]
    assert parsers.answer_key("1 2 3 4\nA B * D") == [(1, "A", False), (2, "B", False), (3, None, True), (4, "D", False)]
    assert parsers.answer_key("1 A 2 X 3 C") == [(1, "A", False), (2, None, True), (3, "C", False)]
    assert parsers.answer_key("nada") == []
    assert parsers.true_false_to_letters([(1, "C", False), (2, "E", False), (3, None, True)]) == [(1, "A", False), (2, "B", False), (3, None, True)]
    assert parsers.true_false_to_letters([(1, "D", False)]) == []


def test_question_parser():
    t = "QUESTÃO 7\nQual a capital?\n(A) Um\ncontinua\n(B) Dois\nAlternativa Correta: B\n\nQuestão 8. Outra?\nA) x\nB) y"
    assert parsers.questions(t) == [(7, "Qual a capital?", 2, "A:Um continua|B:Dois", "B"), (8, "Outra?", 2, "A:x|B:y", None)]
    assert [q[0] for q in parsers.questions("1\nUm texto\nA) a\nB) b\n2.\nDois\nA) c\nB) d")] == [1, 2]
    assert parsers.true_false_items("1 Primeiro item\nsegue.\n2 Segundo.\n7 fora") == [(1, "Primeiro item segue."), (2, "Segundo. 7 fora")]
    assert parsers.discipline_ranges("Português  Matemática\n1 a 10  11 a 20") == [("Português", 1, 10), ("Matemática", 11, 20)]


def test_links_chunks_and_hyphens(spark):
    html = '<h2>2024</h2><a href="/p.pdf">Prova <b>1</b></a><a href="v?file=%2Fq.pdf">G</a><!-- <a href="x">no</a> -->'
    assert parsers.links(html, "https://e.org/a/") == [(1, "https://e.org/p.pdf", "Prova 1", "2024"), (2, "https://e.org/q.pdf", "G", "2024")]
    t = "\n".join(f"linha {n}" for n in range(400))
    c = parsers.chunks(t, 500, 50)
    assert all(len(x[2]) <= 500 for x in c) and c[0][2] + "".join(b[2][c[n][1] + len(c[n][2]) - b[1] :] for n, b in enumerate(c[1:])) == t
    assert parsers.chunks("") == []
    pages = spark.createDataFrame([("d", 1, "A vigilância e a vigi-\nlância; o bem-\nestar, bem-estar; sín\u00ad\ntese"), ("d", 2, "a nova vigi-\n lância da sín-\ntese"), ("e", 1, "a vigi-\nlância"), (None, 1, None)], "doc string, page int, text string")
    fixed = {(r.doc, r.page): (r.text, r.n_joined) for r in hyphens.repaired(pages, ["doc", "page"], "doc", "text").collect()}
    assert fixed == {("d", 1): ("A vigilância e a vigilância; o bem-\nestar, bem-estar; síntese", 2), ("d", 2): ("a nova vigilância da síntese", 2), ("e", 1): ("a vigi-\nlância", 0), (None, 1): (None, 0)}


def test_filters(spark):
    df = spark.createDataFrame([("1", "Fundação X", 2020, 0.9, "Ação"), ("2", None, None, None, "x"), ("3", "Outra", 2021, 0.4, "ação")], "id string, board string, year int, confidence double, statement string")
    f = filters.FilterSet(board=["FUNDACAO x"], year=[2020], search="acao", min_confidence=0.5)
    assert rows(filters.filtered(df, f), "id") == [("1",)]
    assert rows(df.filter(f.early_discard()), "id") == [("1",), ("2",)]
    assert f.merged_with(filters.FilterSet(year=[2020, 2022])).year == [2020]
    with pytest.raises(ValueError):
        f.merged_with(filters.FilterSet(year=[1999]))
    with pytest.raises(ValueError):
        filters.Scope(ids=["1"], everything=True).apply(df)
    assert rows(filters.Scope(ids=["3"]).apply(df), "id") == [("3",)]
    links = spark.createDataFrame([(1, "https://a.org/prova.pdf", "Prova"), (2, "https://a.org/prova.pdf#x", "Prova"), (3, "https://b.org/prova.pdf", "P"), (4, "https://a.org/aviso.pdf", "Aviso")], "ordinal int, url string, title string")
    assert rows(filters.link_filter(links, ["(?i)prova"], ["(?i)aviso"], ["a.org"]), "ordinal") == [(1,)]


def test_quality(spark):
    df = spark.createDataFrame([("",), ("x" * 30,), ("Texto com várias palavras reconhecidas aqui.\n" * 5,)], "t string")
    got = [r.q for r in df.select(quality.ocr_quality(F.col("t"), F.lit(None).cast("double")).alias("q")).collect()]
    assert [g.reason for g in got] == ["too_little_text", "dominant_repetition", None] and got[2].usable
    assert [r.n for r in df.select(quality.needs_ocr(F.col("t")).alias("n")).collect()] == [True, False, False]
    assert spark.range(1).select(quality.gate({"a": F.lit(True), "b": F.lit(False)}, ["a"])).first()[0] == "needs_review"


def test_linkage_reports_ambiguity(spark):
    pairs = spark.createDataFrame(
        [("q1", "k1", ["a"], ["a"]), ("q1", "k2", ["a"], ["b"]), ("q2", "k1", ["a"], ["a"]), ("q2", "k3", ["a"], ["a"]), ("q3", "k1", [], ["a"]), ("q4", "k1", ["a"], ["b"])],
        "q string, k string, l array<string>, r array<string>",
    )
    fields = [linkage.Evidence("f", "l", "r", 10, True)]
    got = {r.q: (r.outcome, r.chosen) for r in linkage.decide(linkage.assess(pairs, fields), "q", "k", 8, 5).collect()}
    assert got == {"q1": ("selected", "k1"), "q2": ("ambiguous", None), "q3": ("incomplete", None), "q4": ("conflict", None)}
    a, b = linkage.decide(linkage.assess(pairs.filter("q = 'q1'"), fields), "q", "k", 8, 5), linkage.decide(linkage.assess(pairs, fields), "q", "k", 8, 5)
    assert linkage.pools_in_order([a, b], "q").count() == 4


def test_joins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, c string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "n int, c string")
    assert rows(joins.compare_versions(old, new, ["n"], "c"), "n", "change") == [(1, "removed"), (2, "changed"), (3, "unchanged"), (4, "added")]
    t = spark.createDataFrame([("1", ["a", "b", "c"])], "id string, toks array<string>")
    assert rows(joins.contained_phrases(t, spark.createDataFrame([("b c",), ("a c",)], "phrase string")), "phrase") == [("b c",)]
    pts = spark.createDataFrame([("d", n) for n in range(1, 60)], "b string, p int")
    rng = spark.createDataFrame([("d", 5, 7, "x"), ("d", 15, 40, "y")], "b string, f int, l int, n string")
    assert joins.in_interval(pts, rng, "b", "p", "f", "l").count() == 3 + 26


def test_windows_and_sets(spark):
    df = spark.createDataFrame([("d", 1, "x", 0.9), ("d", 2, None, 0.1), ("d", 3, "x", 0.9), ("d", 4, None, 0.1), ("d", 5, "y", 0.9)], "d string, n int, v string, c double")
    assert rows(windows.propagate_between(df, ["d"], "n", "v", "c").filter("was_filled"), "n", "v_filled", "filled_confidence") == [(2, "x", 0.78)]
    seq = spark.createDataFrame([("s", "1", "a", "x"), ("s", "2", "a", "y"), ("s", "3", "b", "y"), ("s", "4", "c", "z")], "s string, o string, a string, b string")
    # row 2 is dropped for its first key, so its second key y stays unseen and row 3 is kept
    assert rows(setops.dedupe_either_key(seq, "s", "o", "a", "b"), "o") == [("1",), ("3",), ("4",)]
    with pytest.raises(Exception, match="repeated key"):
        setops.union_distinct_ids([seq, seq], "o").collect()


def test_near_clusters_keep_booklets_apart(spark):
    units = spark.createDataFrame(
        [("a", "s", ["alternativa um", "outra coisa"], ["b1"], "u1"), ("a", "s", ["alternativa um", "outra coisaa"], ["b2"], "u2"), ("a", "s", ["alternativa um", "outra coisas"], ["b1"], "u3"), ("a", "t", ["x"], ["b1"], "u4")],
        "bd string, sk string, alts array<string>, booklets array<string>, unit_id string",
    )
    assert rows(dedup.near_clusters(units, ["bd"], "sk"), "unit_id", "cluster_id") == [("u1", "u1"), ("u2", "u1"), ("u3", "u3"), ("u4", "u4")]
    assert dedup.alternatives_score(["a b c", "d e f"], ["d e f", "a b c"]) == 1.0
    four = ["a primeira alternativa", "a segunda opção", "o terceiro texto", "uma quarta frase"]
    assert dedup.alternatives_compatible(four, [*four[:3], "uma quarta frase\ncabeçalho da página seguinte 12"])
    assert not dedup.alternatives_compatible(four, [*four[:3], "outra coisa bem diferente"])
    assert not dedup.alternatives_compatible(four, four[:3])


def test_chains(spark):
    e = [(f"n{n}", f"n{n - 1}" if n else None) for n in range(20)] + [("c1", "c2"), ("c2", "c1"), ("lost", "nowhere")]
    got = {r.node: (r.root, r.depth) for r in dedup.chain_depth(spark.createDataFrame(e, "node string, predecessor string")).collect()}
    assert got["n19"] == ("n0", 19) and got["n0"] == ("n0", 0) and got["c1"] == (None, None) and got["lost"] == (None, None)


def test_state(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    b = spark.createDataFrame([("b", 9), ("c", 3), ("c", 4)], "k string, v int")
    assert rows(state.insert_ignore(s, b, ["k"]), "k", "v") == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(state.upsert(s, b.filter("v <> 4"), ["k"]), "k", "v") == [("a", 1), ("b", 9), ("c", 3)]
    log = state.audit(s, state.upsert(s, b.filter("v = 9"), ["k"]), ["k"], ["v"])
    assert rows(log, "k", "field_name", "old_value", "new_value") == [("b", "v", "2", "9")]
    changed = spark.createDataFrame([("a", "1"), ("b", "9")], "k string, v string")
    assert rows(state.revert(changed, log, ["k"], "v"), "k", "v") == [("a", "1"), ("b", "2")]
    at = T(2024, 1, 1)
    queue = spark.createDataFrame([("a", 1, "waiting", at), ("b", 2, "waiting", at), ("z", 1, "waiting", at)], "k string, attempts int, status string, next_at timestamp")
    out = spark.createDataFrame([("a", False, at), ("b", True, at), ("c", True, at)], "k string, failed boolean, at timestamp")
    assert rows(state.retry_queue(queue, out, "k", 3, 60).select("k", "attempts", "status"), "*") == [("b", 3, "exhausted"), ("c", 1, "waiting"), ("z", 1, "waiting")]
    made = []
    table = state.StageTable(spark, f"{__import__('tempfile').mkdtemp()}", "stage")
    for _ in range(2):
        assert table.run("k1", lambda: made.append(1) or s).count() == 2
    assert made == [1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "t": "x"}, {"id": 2, "t": None}]))
    assert rows(readers.json_documents(spark, str(tmp_path / "a.json"), "id int, t string"), "id") == [(1,), (2,)]
    (tmp_path / "c.toml").write_text('[[source]]\nid = "s"\nhosts = ["a"]\n')
    assert rows(readers.toml_table(spark, str(tmp_path / "c.toml"), "source", "id string, hosts array<string>"), "id") == [("s",)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.txt", "conteudo")
        z.writestr("../evil.txt", "x")
        z.writestr("bomb.txt", "0" * 3_000_000)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "f.zip").write_bytes(buf.getvalue())
    m = readers.zip_members(readers.binary_files(spark, str(tmp_path / "z")))
    assert rows(m.select("member", "problem"), "*") == [("../evil.txt", "unsafe path"), ("bomb.txt", "ratio"), ("ok.txt", None)]
    pages = readers.extract_pages(readers.binary_files(spark, str(tmp_path / "z")), lambda b: ["um", "", ""])
    assert [tuple(r)[1:] for r in readers.needs_ocr(pages).collect()] == [(3, 1, True)]
    sm = spark.createDataFrame([(1, "<urlset xmlns='u'><url><loc>https://a</loc></url></urlset>")], "id int, body string")
    assert rows(readers.sitemaps(sm, "id", "body"), "kind", "url") == [("urlset", "https://a")]
    fd = spark.createDataFrame([(1, "<rss><channel><item><title>t</title><link>https://a</link></item><item><link>https://a</link></item></channel></rss>")], "id int, body string")
    assert rows(readers.feeds(fd, "id", "body"), "url", "title") == [("https://a", "t")]
    js = spark.createDataFrame([('{"data": {"items": [{"u": "x", "n": {"t": "y"}}, {"u": "z"}]}}',)], "body string")
    assert [tuple(r)[-2:] for r in readers.json_items(js, "body", "data.items", {"url": "u", "title": "n.t"}).collect()] == [("x", "y"), ("z", None)]
    meta = readers.page_metadata(F.lit("<p>Cargo: Analista</p><p>Ano: 2020</p>"), ["cargo", "ano"])
    assert list(spark.range(1).select(*[c.alias(n) for n, c in meta.items()]).first()) == ["Analista", "2020"]
    graph = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a")], "f string, t string")
    seen = readers.frontier(spark.createDataFrame([("a",)], "url string"), lambda f: f.join(graph, f.url == graph.f).select(F.col("t").alias("url")), 10, 5)
    assert rows(seen, "url", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert readers.gunzip_bounded(gzip.compress(b"abc")) == b"abc" and readers.gunzip_bounded(gzip.compress(b"abc"), 2) is None
    q = spark.createDataFrame([("1", True), ("2", False)], "id string, ok boolean")
    assert sinks.write_package(q, str(tmp_path / "pkg"), F.col("ok")).select("n_exported", "n_exceptions").first() == (1, 1)
    assert spark.read.text(str(tmp_path / "pkg/questions")).collect()[0].value == '{"id":"1","ok":true}'
    assert sinks.render_markdown([{"a": 1}], "T").startswith("# T") and "(no rows)" in sinks.render_markdown([], "T")


def test_classification(spark):
    t = "Questão 1\nTexto\n(A) um\n(B) dois"
    got = spark.createDataFrame([("x.pdf", t), ("gabarito", "1 - A\n2 - B\n3 - C"), ("Edital 5", "torna público o edital; inscrições abertas"), ("y", "nada")], "n string, t string").select(classify.triage(F.col("n"), F.col("t")).alias("r")).collect()
    assert [(r.r.decision, r.r.confidence) for r in got] == [("exam", 0.96), ("answer_key", 0.98), ("other", 0.98), ("review", 0.5)]
    assert list(spark.range(1).select(classify.link_type(F.lit("Gabarito"), F.lit("u")), classify.challenge(F.lit("<div class=cf-turnstile>")), classify.challenge(F.lit("<p>ok"))).first()) == ["answer_key", "captcha", None]
    ev = spark.createDataFrame([("d", "year", "a", True, "2020"), ("d", "year", "b", True, "2020"), ("d", "role", "a", True, "x"), ("d", "role", "b", True, "y"), ("d", "board", "t", False, "w")], "d string, f string, source string, strong boolean, value string")
    assert rows(classify.semantic_field(ev, "d", "f"), "f", "state", "vals") == [("board", "known", "w"), ("role", "conflict", None), ("year", "known", "2020")]
    def score(title, url="https://e.org/x"):
        c = classify.navigation_score(F.lit(title), F.lit(url), ["prefeitura x"], ["analista"], [2020], ["fgv"], r"\bprovas\b", r"\bpagina\b", r"\b(prova|provas|gabarito)\b", r"\blicitacao\b")
        return spark.range(1).select(c).first()[0]

    assert score("Provas da Prefeitura X 2020") == 70 + 40 + 25 + 20
    assert score("Provas da Prefeitura X 2019") == 0 and score("Provas") == 0 and score("Prefeitura X licitação") == 0 and score("Prefeitura X", "https://e.org/a.pdf") == 0


def test_pipeline(spark):
    pages = spark.createDataFrame([("d1", 1, "Questão 1\nQual é?\n(A) um\n(B) dois", "prova"), ("d1", 2, "Questão 2\nOutra coisa aqui?\n(A) x\n(B) y", "prova"), ("d2", 1, "Questão 5\nQual é ?\n(A) um\n(B) dois", "prova")], "document_id string, page_number int, text string, name string")
    p = Pipeline()
    docs = p.documents(pages)
    assert rows(docs, "document_id", "decision") == [("d1", "exam"), ("d2", "exam")]
    q = p.questions(docs)
    assert q.count() == 3 and p.distinct_questions(q).count() == 2
    s = spark.createDataFrame([("1", "a", 0.9), ("2", "zz", 0.9), ("3", "a", 0.1), ("4", None, 0.9)], "id string, path string, confidence double")
    assert rows(checked_suggestions(s, spark.createDataFrame([("a",)], "path string"), 0.5), "id", "code") == [("1", "accepted"), ("2", "unknown_path"), ("3", "low_confidence"), ("4", "no_choice")]


def test_pipeline_keeps_questions_of_one_stem(spark):
    stem = "Assinale a alternativa correta."
    texts = [(stem, "um", "dois"), (stem, "três", "quatro"), (stem.upper(), "TRES", " quatro"), (stem, "dois", "um"), ("", "um", "dois"), ("", "x", "y")]
    pages = spark.createDataFrame([("d", 1, "\n".join(f"Questão {n}\n{s}\n(A) {a}\n(B) {b}" for n, (s, a, b) in enumerate(texts, 1)), "prova")], "document_id string, page_number int, text string, name string")
    p = Pipeline()
    q = p.questions(p.documents(pages))
    assert q.count() == 6
    assert rows(p.distinct_questions(q), "number", "n_copies") == [(1, 1), (2, 2), (4, 1), (5, 1), (6, 1)]


def test_alignment_of_many_alternatives():
    from itertools import permutations

    r = random.Random(4)
    for _ in range(150):
        n = r.randrange(1, 7)
        m = [[r.choice([0.0, 0.3, 0.5, 0.72, 0.9, 0.93, 0.94, 0.97, 1.0, r.random()]) for _ in range(n)] for _ in range(n)]
        rank = lambda o: (sum(m[i][j] >= dedup.STRONG for i, j in enumerate(o)), min(m[i][j] for i, j in enumerate(o)), round(sum(m[i][j] for i, j in enumerate(o)), 9))
        assert rank(dedup.best_assignment(m)) == max(map(rank, permutations(range(n))))
    alts = [f"alternativa de nome {w}" for w in "alfa beta gama delta épsilon zeta eta teta iota capa lambda".split()]
    for n in (9, 11):
        assert dedup.alternatives_compatible(alts[:n], alts[:n][::-1]) and dedup.alternatives_score(alts[:n], alts[:n][::-1]) == 1
        assert not dedup.alternatives_compatible(alts[:n], [*alts[: n - 2], "outra coisa", "nada disso"])


def test_digest_registry_of_all_loads(spark, tmp_path):
    obs = [("a", "X ", 1), ("b", "x", 3), ("c", "y", 8), ("d", "y", 5), ("e", "z", None), ("f", "z", 2), ("h", "w", 8), ("g", "w", 8)]
    spark.createDataFrame(obs, "id string, binary_sha256 string, load_no int").write.parquet(str(tmp_path / "document_observations.parquet"))
    assert rows(queries_state.state_insert_ignore(spark, str(tmp_path)), "digest", "id") == [("w", "g"), ("x", "a"), ("y", "d"), ("z", "e")]


def test_retry_queue_of_all_users(spark, tmp_path):
    at = [T(2024, 1, 1, h) for h in range(6)]
    ev = [(u, n, at[n % 6], kind) for n, (u, kind) in enumerate([(1, "view"), (1, "view"), (1, "click"), (2, "view"), (2, "purchase"), (3, "view"), *[(5, "view")] * 6])]
    spark.createDataFrame(ev, "user_id bigint, event_id bigint, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = rows(queries_state.state_retry_queue(spark, str(tmp_path)), "user_id", "attempts", "status", "next_at")
    assert got == [(1, 3, "waiting", T(2024, 1, 1, 2, 4)), (3, 1, "waiting", T(2024, 1, 1, 5, 1)), (5, 5, "exhausted", None)]


def test_facets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), (None, "x")], "f string, g string")
    got = rows(facets.skip_one_facets(df, {"f": F.col("f"), "g": F.col("g")}, {"f": F.col("f") == "a", "g": F.col("g") == "x"}), "facet", "value", "n", "selected")
    assert got == [("f", "a", 1, True), ("f", "b", 1, False), ("g", "x", 1, True), ("g", "y", 1, False)]


def test_marked_questions_and_grids():
    t = "{12}\nQual?\nA) um\nB) dois\n#####\n{13}\nSem fim\nA) x\nB) y\n{14}\nSó uma\nA) x\n#####"
    assert parsers.marked_questions(t) == [(12, "Qual?", 2, "A:um|B:dois", None)]
    g = "Analista – Tipo 1 (Manhã)\n1 2 3\nA B *\nAnalista – Tipo 2 (Manhã)\n1 2 3\nC D E\nTécnico – Tipo 1\n1 - A 2 - B\n1 - C"
    got = parsers.answer_grids(g)
    assert [(x[1], x[2], x[3], x[4], x[5]) for x in got] == [("Analista", 1, "Manhã", 1, "A"), ("Analista", 1, "Manhã", 2, "B"), ("Analista", 1, "Manhã", 3, None), ("Analista", 2, "Manhã", 1, "C"), ("Analista", 2, "Manhã", 2, "D"), ("Analista", 2, "Manhã", 3, "E"), ("Técnico", 1, None, 2, "B")]


def test_segments(spark):
    from lauda.operators import segments

    found = spark.createDataFrame([("d", 1, 1), ("d", 3, 2), ("d", 2, 3), ("d", 2, 4), ("d", 9, 5)], "d string, n int, o int")
    exp = spark.createDataFrame([("d", 1, 5)], "d string, first int, last int")
    assert rows(segments.number_exceptions(found, exp, "d", "n", "o"), "n", "exception") == [(2, "duplicate"), (2, "out_of_order"), (4, "missing"), (5, "missing"), (9, "out_of_range")]
    assert rows(segments.segmentation_metrics(found, exp, "d", "n"), "precision", "coverage") == [(0.75, 0.6)]
    grids = parsers.expand(spark.createDataFrame([("d", "Analista – Tipo 1 (Manhã)\n1 2\nA B\nTécnico – Tipo 1 (Manhã)\n1 2\nC D\nAnalista – Tipo 2 (Tarde)\n1 2\nE A")], "d string, t string"), "d", "t", parsers.answer_grids, parsers.GRID_SCHEMA)
    want = spark.createDataFrame([("d", 1, "manhã", "Analista Judiciário")], "d string, variant int, turn string, role string")
    assert rows(segments.choose_grid(grids, want, "d"), "grid") == [(1,)]


def test_decisions(spark):
    old = spark.createDataFrame([("f1", "exported", "ana"), ("f2", "approved", "bia"), ("f2", "rejected", "bia")], "fp string, status string, reviewer string")
    new = spark.createDataFrame([("f1", "pending", None), ("f2", "pending", None), ("f3", "pending", None)], "fp string, status string, reviewer string")
    assert rows(state.carry_forward(new, old, "fp", "status", ["reviewer"]), "fp", "status", "reviewer", "carried") == [("f1", "approved", "ana", True), ("f2", "pending", None, False), ("f3", "pending", None, False)]
    g = spark.createDataFrame([("g1", "confirmed"), ("g2", "confirmed")], "g string, status string")
    m = spark.createDataFrame([("g1", "a"), ("g2", "b")], "g string, k string")
    assert rows(state.invalidate(g, m, spark.createDataFrame([("b",)], "k string"), "g", "k"), "g", "status") == [("g1", "confirmed"), ("g2", "needs_review")]
    batch, left = state.resume(spark.createDataFrame([(n,) for n in range(9)], "k int"), spark.createDataFrame([(0,), (1,)], "k int"), "k", 3)
    assert rows(batch, "k") == [(2,), (3,), (4,)] and left.first().n_remaining == 4


def test_fetch_boundary(spark):
    from lauda.sources import fetch

    pages = spark.createDataFrame([("https://a.org/x",), ("https://a.org/adm/y",), ("https://b.org/z",)], "url string")
    rules = spark.createDataFrame([("a.org", "/", True), ("a.org", "/adm", False)], "host string, prefix string, allow boolean")
    ok = fetch.allowed_by_robots(pages, rules)
    assert rows(ok, "url") == [("https://a.org/x",), ("https://b.org/z",)]

    def get(url, etag):
        if url.endswith("z"):
            raise OSError("down")
        return (304, etag, None) if etag else (200, "t", b"new")

    cache = spark.createDataFrame([("https://a.org/x", "e1", b"old")], "url string, etag string, body binary")
    got = {r.url: r for r in fetch.fetch(ok, cache, get, 0.0, 1).collect()}
    assert bytes(got["https://a.org/x"].body) == b"old" and got["https://a.org/x"].status == 304
    assert got["https://b.org/z"].attempts == 2 and "down" in got["https://b.org/z"].error


def test_neighbours_and_batches_across_ranges(spark):
    df = spark.createDataFrame([("hot" if n % 3 else f"p{n % 7}", n) for n in range(300)], "d string, n int").repartition(5)
    parts: dict[str, list[int]] = {}
    for n in range(300):
        parts.setdefault("hot" if n % 3 else f"p{n % 7}", []).append(n)
    expected = sorted((d, x, v[i - 1] if i else None, v[i + 1] if i + 1 < len(v) else None) for d, v in parts.items() for i, x in enumerate(v))
    got = windows.with_neighbours(df, ["d"], "n", ["n"]).select("d", "n", "prev_n", "next_n").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0], r[1])) == expected
    assert rows(windows.batches(df, ["n"], 7), "n", "batch_no") == [(n, n // 7) for n in range(300)]
    assert windows.with_neighbours(df.limit(0), ["d"], "n", ["n"]).count() == 0


def test_key_selection(spark):
    fields = list(linkage.KEY_WEIGHTS)

    def pair(exam, key, phase="definitive", interval=(1, 60), weak=(), **changed):
        row = {"exam": exam, "key": key, "k_phase": phase, "e_interval": (1, 60), "k_interval": interval}
        for f in fields:
            row[f"e_{f}"], row[f"k_{f}"] = [f"{f} x"], changed.get(f, [f"{f} x"])
            row[f"e_{f}_weak"], row[f"k_{f}_weak"] = False, f in weak
        return row

    schema = "exam string, key string, k_phase string, e_interval struct<first:int,last:int>, k_interval struct<first:int,last:int>, " + ", ".join(
        f"e_{f} array<string>, k_{f} array<string>, e_{f}_weak boolean, k_{f}_weak boolean" for f in fields
    )
    data = [
        pair("a", "k1"), pair("a", "k2", "preliminary"), pair("b", "k1"), pair("b", "k3"), pair("c", "k2", "preliminary"), pair("d", "k1", interval=(1, 50)),
        pair("e", "k1", year=[]), pair("f", "k1", turn=[]), pair("g", "k1", "unknown"), pair("h", "k1", weak=("stage",)), pair("i", "k1", role=["role y"]),
    ]
    df = spark.createDataFrame(data, schema)
    got = {r.exam: (r.outcome, r.chosen) for r in linkage.select_keys(linkage.assess_keys(df), "exam", "key").collect()}
    assert got == {
        "a": ("selected", "k1"), "b": ("ambiguous", None), "c": ("awaiting_definitive", None), "d": ("conflict", None), "e": ("incomplete", None), "f": ("selected", "k1"),
        "g": ("selected", "k1"), "h": ("incomplete", None), "i": ("conflict", None),
    }


def test_shared_folder_and_cleaning(spark, monkeypatch):
    import os

    from lauda import session

    df = session.materialize(spark.range(5).withColumn("part", F.col("id") % 2), "gone", "part")
    assert sorted(r.id for r in df.filter("part = 1").collect()) == [1, 3]
    path = df._lauda_path.removeprefix("file://")
    assert os.path.isdir(path)
    session.release(df)
    assert not os.path.exists(path) and df._lauda_path not in session._WRITTEN
    kept = session.materialize(spark.range(3), "kept")._lauda_path
    session.release_all(spark)
    assert not session._WRITTEN and not os.path.exists(kept.removeprefix("file://"))

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_bucketed_table_is_not_shuffled(spark):
    from lauda.buckets import Bucketed

    t = Bucketed(spark, "probe", "k bigint, v bigint", ["k"], 4)
    assert t.read().count() == 0
    for n in range(2):
        t.append(spark.range(100).select(F.col("id").alias("k"), F.lit(n).cast("bigint").alias("v")))
    other = spark.range(50).select(F.col("id").alias("k"))
    joined = t.read().join(other.hint("merge"), "k")
    assert joined.count() == 100
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert t.read().groupBy("k").agg(F.sum("v").alias("s")).filter("s = 1").count() == 100
    t.drop()


def test_chain_depth_of_long_chains_and_repeated_rows(spark):
    e = [(f"n{n:03d}", f"n{n - 1:03d}" if n else None) for n in range(300)] + [("n005", "n004"), (None, "n001"), ("a", "a"), ("tail", "a")]
    got = {r.node: (r.root, r.depth) for r in dedup.chain_depth(spark.createDataFrame(e, "node string, predecessor string")).collect()}
    assert got["n299"] == ("n000", 299) and got["a"] == got["tail"] == (None, None) and len(got) == 302
    assert dedup.chain_depth(spark.createDataFrame([], "node string, predecessor string")).count() == 0


def test_answers_across_permuted_alternatives(spark):
    own, ref = ["um texto", "outro texto aqui", "mais um"], ["mais um", "um texto", "outro texto aqui!"]
    assert dedup.mapped_answer("outro texto aqui", own, ref) == "outrotextoaqui" and dedup.mapped_answer("Mais  um.", own, ref) == "maisum"
    assert dedup.mapped_answer("outro texto aquj", ["x"], ref) == "outrotextoaqui" and dedup.mapped_answer("nada", own, ref) == "nada" and dedup.mapped_answer(None, own, ref) is None
    members = [("g", "um texto", own), ("g", "um texto", ref), ("h", "um texto", own), ("h", "mais um", ref), ("i", None, own)]
    m = spark.createDataFrame(members, "g string, answer_text string, alts array<string>")
    reps = spark.createDataFrame([(g, ref) for g in "ghi"], "g string, rep_alts array<string>")
    assert rows(dedup.answer_consensus(m, "g", reps), "g", "n_answers", "n_values", "outcome", "answer_text") == [("g", 2, 1, "agreed", "umtexto"), ("h", 2, 2, "conflict", None), ("i", 0, 0, "missing", None)]


def test_greedy_clusters_against_plain_merging():
    """The one-pass clusters equal merging the first compatible pair of clusters until none is left."""
    r = random.Random(6)
    for _ in range(60):
        units = [(f"u{n}", [r.choice(["abcdefghij", "abcdefghik", "abcdefgzzk", "qwertyuiop"]) for _ in range(2)], {f"b{r.randrange(5)}"}) for n in range(9)]
        clusters, merged = [[n] for n in range(len(units))], True
        while merged:
            merged = False
            for i in range(len(clusters)):
                for j in range(i + 1, len(clusters)):
                    books = [set().union(*(units[n][2] for n in c)) for c in (clusters[i], clusters[j])]
                    if not books[0] & books[1] and all(dedup.alternatives_compatible(units[a][1], units[b][1]) for a in clusters[i] for b in clusters[j]):
                        clusters[i] += clusters.pop(j)
                        merged = True
                        break
                if merged:
                    break
        assert sorted(map(sorted, dedup.complete_linkage(units))) == sorted(map(sorted, clusters))


def test_association_edges(spark):
    from lauda.operators import association as a

    alts = lambda *t: [(letter, x) for letter, x in zip("ABCDE", t)]
    d = spark.createDataFrame([(alts("um", "dois", "três"), alts("Dois.", "um", "dois")), ([], alts("um")), (None, alts("um")), ([(None, "um"), ("A", None), ("B", "um"), ("B", "x")], alts("um"))], "o array<struct<letter:string,text:string>>, r array<struct<letter:string,text:string>>")
    assert [x.m for x in d.select(a.letter_map(F.col("o"), F.col("r")).alias("m")).collect()] == [{"A": "B"}, {}, None, {"B": "A"}]
    left = spark.createDataFrame([("e1", "b", "t1", "r"), ("e2", "b", "tx", "r"), ("e3", "b", "tx", "rx"), ("e4", None, "t1", "r")], "e string, b string, t string, r string")
    right = spark.createDataFrame([("k1", "b", "t1", "q"), ("k2", "b", "t2", "r"), ("k2", "b", "t2", "r")], "k string, b string, t string, r string")
    assert rows(a.blocked_pairs(left, right, ["b"], [["t"], ["r"], []], "e", "k"), "e", "k", "tier") == [("e1", "k1", 1), ("e2", "k2", 2), ("e3", "k1", 3), ("e3", "k2", 3)]
    cur, rec = (spark.createDataFrame(x, "k string, v string") for x in ([("1", "A"), ("2", "B"), ("3", "C")], [("1", "A"), ("2", "C"), ("4", "D")]))
    audited = a.audit(cur, rec, "k", "v")
    assert rows(audited, "k", "state") == [("1", "confirmed"), ("2", "divergent"), ("3", "unsupported"), ("4", "missing")]
    assert rows(a.apply_audit(audited), "k", "value") == [("1", "A"), ("2", "B"), ("3", "C"), ("4", "D")] and rows(a.apply_audit(audited, True), "k", "value")[1] == ("2", "C")
    s = spark.createDataFrame([("e", "k1", 40, "definitive", None), ("e", "k2", 40, "preliminary", None), ("f", "k1", 40, "unknown", None), ("f", "k2", 40, "unknown", "k1"), ("g", "k1", 40, "unknown", None), ("g", "k2", 40, "unknown", None), ("h", "k1", 30, "definitive", None)], "e string, k string, score int, phase string, predecessor string")
    assert rows(a.older_choice(s, "e", "k"), "e", "outcome", "chosen") == [("e", "selected", "k1"), ("f", "selected", "k2"), ("g", "ambiguous", None), ("h", "below_minimum", None)]
    b = spark.createDataFrame([("http://x/a#1", 5.0), ("http://x/a", 7.0), ("http://x/b", 7.0), ("http://x/c", 1.0), (None, 9.0)], "u string, s double").filter("u is not null")
    assert [tuple(x) for x in a.top_distinct(b, "s", "u", 2, 5).collect()] == [("http://x/a", 7.0), ("http://x/b", 7.0)]
