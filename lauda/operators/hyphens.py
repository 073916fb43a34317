"""Words cut at line ends, joined on the evidence of their whole document. JVM only.

Cut words are the few rows that leave a page; a document's spellings are looked up for these alone. A
soft hyphen before a small letter always joins; a hard one joins when the document writes the word in one
piece elsewhere (or joined it at a soft hyphen); a hyphenated spelling elsewhere forbids it.

Edge cases: null texts are kept as null and give no cut; pages of a null document are documents of their
own kind, taken together; a page delivered twice is repaired twice alike; a line with a cut at both ends is
joined on both sides; the number of lines of a page bounds its cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOFT, HARD = "\u00ad", "-"
_LEFT, _RIGHT = rf"(\p{{L}}{{2,}})([{HARD}{SOFT}])[ \t\r]*$", r"^[ \t]*(\p{L}{2,})"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def cut_words(pages: DataFrame, key: list[str], doc: str, text: str) -> DataFrame:
    """(key, doc, line_no, head, mark, tail) of every word that a line end cuts before a small letter."""
    lines = _lines(F.col(text))
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(lines) - 1),
        lambda n: F.struct(n.alias("line_no"), F.element_at(lines, n).alias("left"), F.element_at(lines, n + 1).alias("right")),
    )
    cut = F.filter(pairs, lambda p: p["left"].rlike(_LEFT) & p["right"].rlike(r"^[ \t]*\p{Ll}\p{L}"))
    rows = pages.filter(F.col(text).contains("\n")).select(*dict.fromkeys([*key, doc]), F.explode(cut).alias("p"))
    return rows.select(
        *dict.fromkeys([*key, doc]), "p.line_no", F.regexp_extract("p.left", _LEFT, 1).alias("head"), F.regexp_extract("p.left", _LEFT, 2).alias("mark"), F.regexp_extract("p.right", _RIGHT, 1).alias("tail")
    )


def joins(pages: DataFrame, key: list[str], doc: str, text: str) -> DataFrame:
    """(key, line_no): lines whose last word is to be joined with the next line."""
    cuts = cut_words(pages, key, doc, text).withColumns(
        {"one": F.lower(F.concat("head", "tail")), "two": F.lower(F.concat_ws(HARD, "head", "tail")), "soft": F.col("mark") == SOFT}
    )
    asked = cuts.select(doc, F.explode(F.array("one", "two")).alias("spelling")).distinct()
    whole = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_-])\p{L}+(?:-\p{L}+)*(?![\p{L}\p{N}_-])"), 0)
    written = pages.select(doc, F.explode(F.array_distinct(whole)).alias("spelling")).unionByName(cuts.filter("soft").select(doc, F.col("one").alias("spelling")))
    asked = asked.withColumnsRenamed({doc: "_d0", "spelling": "_s0"})
    known = written.join(asked, F.col(doc).eqNullSafe(F.col("_d0")) & (F.col("spelling") == F.col("_s0")), "left_semi").distinct()
    one = known.select(F.col(doc).alias("_d1"), F.col("spelling").alias("_s1"), F.lit(True).alias("plain"))
    two = known.select(F.col(doc).alias("_d2"), F.col("spelling").alias("_s2"), F.lit(True).alias("compound"))
    judged = cuts.join(one, F.col(doc).eqNullSafe(F.col("_d1")) & (F.col("one") == F.col("_s1")), "left").join(two, F.col(doc).eqNullSafe(F.col("_d2")) & (F.col("two") == F.col("_s2")), "left")
    return judged.filter(F.col("compound").isNull() & (F.col("soft") | F.col("plain").isNotNull())).select(*key, "line_no")


def repaired(pages: DataFrame, key: list[str], doc: str, text: str) -> DataFrame:
    """pages with their cut words joined and n_joined, how many; key has to name a page."""
    per = joins(pages, key, doc, text).groupBy(*key).agg(F.collect_set("line_no").alias("_cut"))
    per = per.withColumnsRenamed({c: f"_k_{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    both = pages.join(per, same, "left").select(*pages.columns, F.coalesce("_cut", F.array().cast("array<int>")).alias("_cut"))
    ends = lambda n: F.array_contains("_cut", n)

    def piece(line: Column, at: Column) -> Column:
        cut, joined = ends(at + 1), ends(at)  # positions count from 0, lines from 1
        body = F.when(joined, F.ltrim(line)).otherwise(line)
        return F.when(cut, F.regexp_replace(body, rf"[{HARD}{SOFT}][ \t\r]*$", "")).otherwise(F.concat(body, F.lit("\n")))

    fixed = F.array_join(F.transform(_lines(F.col(text)), piece), "")
    return both.withColumns({text: F.when(F.size("_cut") > 0, F.substr(fixed, F.lit(1), F.length(fixed) - 1)).otherwise(F.col(text)), "n_joined": F.size("_cut")}).drop("_cut")
