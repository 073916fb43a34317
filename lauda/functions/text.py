"""Text normalization as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache
def _accent_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus marks, and those base letters."""
    src, dst = [], []
    for c in [*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x1E00, 0x2000)]:
        d = unicodedata.normalize("NFD", chr(c))
        if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:]):
            src.append(chr(c))
            dst.append(d[0])
    return "".join(src), "".join(dst)


def strip_accents(c: Column) -> Column:
    """Composed accents to base letters, combining marks removed."""
    return F.regexp_replace(F.translate(c, *_accent_table()), r"\p{M}+", "")


def fold_keep_space(c: Column) -> Column:
    """Lower case without accents; the sharp s becomes ss as in full case folding."""
    return strip_accents(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")))


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\u00a0\u2000-\u200b\u3000]+", " "))


def fold(c: Column) -> Column:
    """Accent- and case-insensitive form with single blanks."""
    return squeeze(fold_keep_space(c))


def alnum(c: Column) -> Column:
    """Folded text with everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(fold_keep_space(c), r"[^a-z0-9]+", " "))


def unicode_alnum(c: Column) -> Column:
    """Folded text with everything but letters and digits as single blanks."""
    return F.trim(F.regexp_replace(fold_keep_space(c), r"[^\p{L}\p{N}]+", " "))


def comparison_key(c: Column) -> Column:
    """Letters and digits of the folded text only."""
    return F.regexp_replace(fold_keep_space(c), r"[^\p{L}\p{N}]", "")


def slug(c: Column, length: int = 80) -> Column:
    """Hyphen-joined ascii slug of bounded length."""
    return F.rtrim(F.substring(F.regexp_replace(alnum(c), " ", "-"), 1, length), F.lit("-"))


def words(c: Column) -> Column:
    """Array of folded words (runs of letters and digits)."""
    return F.regexp_extract_all(fold_keep_space(c), F.lit(r"[\p{L}\p{N}]+"), 0)


#: Words that carry no identity when titles of documents are compared.
STOP_TOKENS = (
    "arquivo caderno com concurso concursos da das de definitivo definitiva do dos em exame exames fase gabarito gabaritos oficial pdf para por "
    "processo processos prova provas questao questoes resposta respostas selecao selecoes seletiva seletivas seletivo seletivos sem"
).split()


def tokens(c: Column) -> Column:
    """Distinct tokens of two or more characters without the stop tokens."""
    found = F.filter(F.regexp_extract_all(fold_keep_space(c), F.lit("[a-z0-9]+"), 0), lambda t: F.length(t) > 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_TOKENS)))


def identifier_evidence(toks: Column) -> Column:
    """How many tokens carry a digit, at most eight."""
    return F.least(F.lit(8), F.size(F.filter(toks, lambda t: t.rlike("[0-9]"))))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token sets; null when both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def tokens_match(a: Column, b: Column) -> Column:
    """At least two common tokens and a Jaccard of 0.55 or more."""
    return (F.size(F.array_intersect(a, b)) >= 2) & (token_jaccard(a, b) >= 0.55)


def question_text(c: Column) -> Column:
    """Statement as compared: newlines unified, header lines of parsers dropped, blanks squeezed, lower
    case, leading question number removed."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n")
    lines = F.filter(F.transform(lines, squeeze), lambda x: (x != "") & ~x.rlike("(?iu)^(concurso p[uú]blico.*|.*\\btipo [1-9][0-9]* ?[-–—]? ?p[aá]gina [0-9]+)$"))
    return F.regexp_replace(F.lower(F.array_join(lines, " ")), r"^\s*(?:quest(?:ão|ao)|q\.?)[-_ ]*[0-9]+\s*[).\-:]?\s*", "")


def alternative_text(c: Column) -> Column:
    """Alternative as compared: blanks squeezed, lower case, leading letter removed."""
    return F.regexp_replace(F.lower(squeeze(c)), r"^\s*[a-h]\s*[).\-:]\s*", "")


def page_text(c: Column) -> Column:
    """Page as compared: blanks squeezed inside lines, runs of blank lines to one."""
    t = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def triage_text(c: Column, multiline: bool = False) -> Column:
    """Folded text with underscores (and, on one line, hyphens) as blanks."""
    t = F.translate(fold_keep_space(c), "_" if multiline else "_-", " " if multiline else "  ")
    return t if multiline else squeeze(t)


def header_token(c: Column) -> Column:
    """Line without a trailing page number, folded."""
    return F.regexp_replace(fold(c), r"\s*[0-9]+\s*$", "")


def is_caps_heading(c: Column) -> Column:
    """A line of two or more words and at most 72 characters, all in upper case."""
    t = squeeze(c)
    return (F.length(t) <= 72) & (t == F.upper(t)) & (t != F.lower(t)) & (F.size(F.split(t, " ")) >= 2)


def cut_artifacts(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(text before the first line that matches a pattern, dropped part's pattern numbers)."""
    lines = F.split(text, "\n")
    
    def hits(pattern: str) -> Column:
        return F.transform(lines, lambda x: x.rlike(pattern))

    hit = [hits(p) for p in patterns]
    first = F.least(*[F.coalesce(F.nullif(F.array_position(h, True), F.lit(0)), F.size(lines) + 1) for h in hit], F.size(lines) + 1)
    kept = F.rtrim(F.array_join(F.slice(lines, 1, (first - 1).cast("int")), "\n"))
    codes = F.array_compact(F.array(*[F.when(F.array_contains(h, True), n) for n, h in enumerate(hit, 1)]))
    return kept, codes


def apply_reviewed_replacement(c: Column, wrong: str, right: str) -> Column:
    """Exact replacement of a reviewed spelling; null where it doesn't occur exactly once."""
    import re

    return F.when(F.regexp_count(c, F.lit(re.escape(wrong))) == 1, F.replace(c, F.lit(wrong), F.lit(right)))
