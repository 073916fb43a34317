import datetime
import math
import uuid

from pyspark.sql import functions as F

from lauda.functions import dates, hashing, stats, text, urls


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return list(row.select(*cols).first())


def test_text_forms(spark):
    s = "  Ação –  ÓRGÃO Straße n.º 5 "
    assert one(spark, text.fold(F.col("s")), text.alnum(F.col("s")), text.comparison_key(F.col("s")), text.slug(F.col("s"), 10), s=s) == ["acao – orgao strasse n.º 5", "acao orgao strasse n 5", "acaoorgaostrassenº5", "acao-orgao"]
    assert one(spark, text.question_text(F.col("s")), text.alternative_text(F.col("t")), s="CONCURSO PÚBLICO 1\nQuestão 12 - Qual  é?", t=" B) Um  dois") == ["qual é?", "um dois"]
    assert one(spark, text.page_text(F.col("s")), text.header_token(F.col("s")), s="A  b \r\n\r\n\r\n c 12") == ["A b\n\nc 12", "a b c"]
    assert one(spark, text.is_caps_heading(F.lit("LÍNGUA PORTUGUESA")), text.is_caps_heading(F.lit("Língua PORTUGUESA")), text.is_caps_heading(F.lit("UMA"))) == [True, False, False]
    kept, codes = text.cut_artifacts(F.col("s"), ["^Página", "^Fim"])
    assert one(spark, kept, codes, s="a\nb\nPágina 3\nc\nFim") == ["a\nb", [1, 2]]
    assert one(spark, text.apply_reviewed_replacement(F.col("s"), "ab", "x"), s="ab cd") == ["x cd"] and one(spark, text.apply_reviewed_replacement(F.col("s"), "ab", "x"), s="ab ab") == [None]
    assert one(spark, text.tokens_match(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd"))), text.identifier_evidence(F.array(F.lit("a1"), F.lit("b")))) == [False, 1]


def test_dates(spark):
    assert one(spark, dates.years(F.col("s")), dates.only_year(F.col("t")), dates.slug_year(F.col("u")), s="2024 e 1999, 20245", t="de 2001", u="prova-98") == [[1999, 2024], 2001, 1998]
    assert [(p.year, p.semester) for p in one(spark, dates.periods(F.col("s")), s="2024/1 e 03/09/2023")[0]] == [(2023, 2), (2024, 1)]
    assert one(spark, dates.shift(F.col("s")), dates.shift(F.col("t")), s="Turno da Manhã", t="manhã e tarde") == ["manha", None]
    assert one(spark, dates.expand_range(F.col("s")), dates.expand_range(F.col("t")), s="2 a 4", t="x") == [[2, 3, 4], None]
    now = datetime.datetime(2024, 1, 1)
    assert one(spark, dates.retry_wait(F.lit("30"), F.lit(now)), dates.backoff(F.lit(now), F.lit(3), 60), dates.iso_utc(F.lit(now))) == [30.0, now + datetime.timedelta(seconds=240), "2024-01-01T00:00:00.000000+00:00"]


def test_statistics(spark):
    assert one(spark, *stats.wilson(F.lit(137), F.lit(175)), stats.percent(F.lit(137), F.lit(175)), stats.percent(F.lit(1), F.lit(0))) == [71.605, 83.751, 78.286, 0.0]
    for b, c in ((21, 6), (0, 0), (3, 3), (1200, 1100)):
        n, k = b + c, min(b, c)
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
        assert abs(one(spark, stats.mcnemar_p(F.lit(b), F.lit(c)))[0] - exact) < 1e-9
    seats = stats.largest_remainder(spark.createDataFrame([("a", 50), ("b", 30), ("c", 20)], "k string, n bigint"), "k", "n", 7).select("k", "share")
    assert dict(map(tuple, seats.collect())) == {"a": 4, "b": 2, "c": 1}


def test_identities(spark):
    name = "doc:ação"
    assert one(spark, hashing.uuid5(hashing.NAMESPACE_URL, F.lit(name))) == [str(uuid.uuid5(uuid.NAMESPACE_URL, name))]
    a = hashing.invariant_fingerprint(F.lit("X?"), F.array(F.lit("A) um"), F.lit("dois")))
    b = hashing.invariant_fingerprint(F.lit("x?"), F.array(F.lit("Dois"), F.lit("um")))
    same, other = one(spark, a == b, hashing.exact_fingerprint(F.lit("x"), F.array(F.lit("a"), F.lit("b"))) == hashing.exact_fingerprint(F.lit("x"), F.array(F.lit("b"), F.lit("a"))))
    assert same and not other
    assert one(spark, hashing.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"))) == ['{"a":null,"b":1}']


def test_urls(spark):
    u = "HTTPS://Example.COM:443//a//b?utm_source=x&b=2&a=1&sig=Z#frag"
    assert one(spark, urls.canonical(F.lit(u)), urls.is_signed(F.lit(u)), urls.redact(F.lit(u)), urls.host(F.lit(u))) == ["https://example.com/a/b?a=1&b=2", True, "HTTPS://Example.COM:443//a//b?utm_source=x&b=2&a=1#frag", "example.com"]
    assert one(spark, urls.canonical(F.lit("ftp://x/y")), urls.canonical(F.lit("https://u:p@x/")), urls.canonical(F.lit("http://x:8080"))) == [None, None, "http://x:8080/"]
    assert one(spark, urls.in_allowlist(F.lit("https://a.example.com/x"), ["example.com"]), urls.in_allowlist(F.lit("https://badexample.com"), ["example.com"]), urls.is_safe_link(F.lit("https://x/login")), urls.redact_in_text(F.lit("see https://x/y?token=1&a=2 end"))) == [True, False, False, "see https://x/y?a=2 end"]


def test_document_routes_sections_and_blocks():
    from lauda.operators import parsers

    tf = "Julgue os itens a seguir.\n1 A água ferve.\n2 O gelo queima."
    assert parsers.route(tf, "CEBRASPE (Cespe)") == "true_false" and parsers.route(tf, "outra") == "generic" and parsers.route("1 x", "Cebraspe", "true_false") == "true_false"
    assert [(r[0], r[1]) for r in parsers.parse_document(tf, "Cebraspe")] == [("true_false", 1), ("true_false", 2)]
    marked = "{01}\nPergunta?\nA) um\nB) dois\n#####"
    assert [(r[0], r[1], r[3]) for r in parsers.parse_document(marked)] == [("marked", 1, 2)]
    assert parsers.parse_document("QUESTÃO 1\nTexto\nA) um\nB) dois")[0][:2] == ("generic", 1) and parsers.parse_document("") == []
    got = parsers.section_exceptions([1, 3, 2, 3, 12, 99], [("a", 1, 4), ("b", 11, 12)])
    assert got == [("a", "missing", 4), ("a", "duplicate", 3), ("a", "out_of_order", 2), ("b", "missing", 11), (None, "out_of_range", 99)]
    keys = parsers.answer_blocks("Caderno A\n1-B 2-C\nCaderno B 1-D\n2-E\nCaderno C\n1-A\n1-B", r"caderno\s+(\w)\b")
    assert keys == {"A": [(1, "B", False), (2, "C", False)], "B": [(1, "D", False), (2, "E", False)], "C": []}
    assert parsers.answer_blocks("Caderno A 1-B\nCaderno B 1-C\nCaderno A 2-D", r"caderno\s+(\w)\b")["A"] == [(1, "B", False), (2, "D", False)]
