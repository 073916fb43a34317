"""Record filters compiled to predicates: conjunctive, three-valued and skip-one forms."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lauda.functions import text as t
from lauda.session import checked_broadcast


def fold_literal(value: str) -> str:
    """The folded form of a request value, made the way the column form makes it."""
    import unicodedata

    v = "".join(c for c in unicodedata.normalize("NFKD", value.casefold()) if not unicodedata.combining(c))
    return " ".join(v.split())


def fold_equals(c: Column, wanted: list[str]) -> Column:
    """Accent- and case-insensitive membership; false for null."""
    return F.coalesce(t.fold(c).isin([fold_literal(w) for w in wanted]), F.lit(False))


def contains_or_alias(c: Column, wanted: str, groups: list[list[str]]) -> Column:
    """Request contained in the value, or both in one alias group."""
    w, folded = fold_literal(wanted), t.fold(c)
    same = [g for g in ([fold_literal(x) for x in group] for group in groups) if any(x == w or w in x for x in g)]
    hit = folded.contains(w)
    for g in same:
        for alias in g:
            hit = hit | (folded == alias)
    return F.coalesce(hit, F.lit(False))


def full_text(term: str, *cols: Column) -> Column:
    """Folded term contained in the folded columns taken together."""
    return F.coalesce(t.fold(F.concat_ws(" ", *cols)).contains(fold_literal(term)), F.lit(False))


@dataclass(frozen=True)
class FilterSet:
    """A conjunction of multi-value requests; empty lists ask nothing."""

    board: list[str] = field(default_factory=list)
    organization: list[str] = field(default_factory=list)
    role: list[str] = field(default_factory=list)
    matter: list[str] = field(default_factory=list)
    subject: list[str] = field(default_factory=list)
    level: list[str] = field(default_factory=list)
    year: list[int] = field(default_factory=list)
    search: str = ""
    min_confidence: float | None = None

    def parts(self, aliases: dict[str, str] | None = None) -> dict[str, Column]:
        """One predicate per requested facet; null values fail a requested facet."""
        out: dict[str, Column] = {}
        for f in fields(self):
            v = getattr(self, f.name)
            c = F.col((aliases or {}).get(f.name, f.name)) if f.name not in ("search", "min_confidence") else None
            if f.name == "year" and v:
                out["year"] = F.coalesce(c.isin(v), F.lit(False))
            elif f.name == "search" and v:
                out["search"] = full_text(v, F.col("statement"))
            elif f.name == "min_confidence" and v is not None:
                out["min_confidence"] = F.coalesce(F.col("confidence") >= v, F.lit(False))
            elif isinstance(v, list) and v:
                out[f.name] = fold_equals(c, v)
        return out

    def predicate(self, but: str | None = None) -> Column:
        """All parts, or all but one facet."""
        p = F.lit(True)
        for name, part in self.parts().items():
            if name != but:
                p = p & part
        return p

    def early_discard(self) -> Column:
        """True for rows to keep: only a known value that contradicts drops a row."""
        keep = F.lit(True)
        for name, part in self.parts().items():
            if name not in ("search", "min_confidence"):
                keep = keep & (F.col(name).isNull() | part)
        return keep

    def merged_with(self, other: "FilterSet") -> "FilterSet":
        """Requests that satisfy both; a contradiction raises."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(other, f.name)
            if isinstance(a, list):
                key = (lambda x: x) if f.name == "year" else fold_literal
                both = [x for x in a if key(x) in {key(y) for y in b}] if a and b else a or b
                if a and b and not both:
                    raise ValueError(f"filters contradict each other in {f.name}")
                out[f.name] = both
            elif f.name == "search":
                if a and b and fold_literal(a) != fold_literal(b):
                    raise ValueError("filters contradict each other in search")
                out["search"] = a or b
            else:
                out[f.name] = max((x for x in (a, b) if x is not None), default=None)
        return FilterSet(**out)


def filtered(df: DataFrame, wanted: FilterSet) -> DataFrame:
    return df.filter(wanted.predicate())


def filter_report(df: DataFrame, wanted: FilterSet) -> DataFrame:
    """One row: accepted and rejected rows, in one scan."""
    p = wanted.predicate()
    return df.agg(F.count_if(p).alias("n_accepted"), F.count_if(~p).alias("n_rejected"))


def in_period(year: Column, first: int, last: int) -> Column:
    """Unknown years pass."""
    return year.isNull() | year.between(first, last)


def link_filter(links: DataFrame, include: list[str], exclude: list[str], hosts: list[str]) -> DataFrame:
    """Links (ordinal, url, title): any exclude pattern drops, any include pattern keeps, host in the
    allow-list, the first of equal URLs."""
    from pyspark.sql import Window

    from lauda.functions import urls

    both = F.concat_ws(" ", "title", "url")
    keep, drop = F.lit(not include), F.lit(False)
    for p in include:
        keep = keep | both.rlike(p)
    for p in exclude:
        drop = drop | both.rlike(p)
    ok = links.filter(keep & ~drop & urls.in_allowlist(F.col("url"), hosts) & urls.is_safe_link(F.col("url")))
    first = F.row_number().over(Window.partitionBy(urls.canonical(F.col("url"))).orderBy("ordinal"))
    return ok.withColumn("_n", first).filter("_n = 1").drop("_n")


@dataclass(frozen=True)
class Scope:
    """What an operation applies to: chosen ids, a filter, or all. Exactly one."""

    ids: list[str] | None = None
    filters: FilterSet | None = None
    everything: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if sum((self.ids is not None, self.filters is not None, self.everything)) != 1:
            raise ValueError("a scope names ids, a filter or everything, and only one of them")
        if self.ids is not None:
            wanted = df.sparkSession.createDataFrame([(i,) for i in self.ids], "id string")
            return df.join(checked_broadcast(wanted), "id", "left_semi")
        return filtered(df, self.filters) if self.filters is not None else df


def public_view(df: DataFrame, hidden: list[str], items: int = 32, chars: int = 160) -> DataFrame:
    """Projection for the outside: named columns gone, lists and strings cut to bounds."""
    out = []
    for f in df.schema.fields:
        if f.name in hidden:
            continue
        c, kind = F.col(f.name), f.dataType.simpleString()
        if kind == "string":
            c = F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("…"))).otherwise(c)
        elif kind.startswith("array"):
            c = F.slice(c, 1, items)
        out.append(c.alias(f.name))
    return df.select(*out)


def coalesced(own: Column, inherited: Column) -> Column:
    """A value, or the inherited one where it is null or blank."""
    return F.coalesce(F.when(F.trim(own) != "", own), inherited)
