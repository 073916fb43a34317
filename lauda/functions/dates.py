"""Years, periods, shifts and retry times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lauda.functions.text import fold


def years(c: Column) -> Column:
    """Sorted distinct four-digit years 1900 to 2099 that stand alone among digits."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def only_year(c: Column) -> Column:
    """The year of a text that names exactly one."""
    y = years(c)
    return F.when(F.size(y) == 1, y[0])


def slug_year(c: Column) -> Column:
    """Year behind a two-digit number at a slug's end: below 80 it is 20xx, else 19xx."""
    n = F.regexp_extract(c, r"(?<![0-9])([0-9]{2})(?:\D*)$", 1)
    v = F.when(n != "", n.cast("int"))
    return F.when(v < 80, 2000 + v).otherwise(1900 + v)


def periods(c: Column) -> Column:
    """Distinct (year, semester) from 2024/1 or from dates dd/mm/yyyy."""
    c = F.regexp_replace(c, r"\s*/\s*", "/")
    term = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?<![0-9/])((?:19|20)[0-9]{2}/[12])(?![0-9])"), 1),
        lambda x: F.struct(F.substring(x, 1, 4).cast("int").alias("year"), F.substring(x, 6, 1).cast("int").alias("semester")),
    )
    dates = F.transform(
        F.regexp_extract_all(c, F.lit(r"(?<![0-9])[0-3]?[0-9]/((?:0?[1-9]|1[0-2])/(?:19|20)[0-9]{2})(?![0-9])"), 1),
        lambda x: F.struct(F.substring_index(x, "/", -1).cast("int").alias("year"), F.when(F.substring_index(x, "/", 1).cast("int") <= 6, 1).otherwise(2).alias("semester")),
    )
    return F.array_sort(F.array_distinct(F.concat(term, dates)))


def shift(c: Column) -> Column:
    """Shift named by a text: manha before tarde before noite; null when none or several are named."""
    t = fold(c)
    named = F.array_compact(F.array(*[F.when(t.rlike(rf"\b{w}\b"), F.lit(w)) for w in ("manha", "tarde", "noite")]))
    return F.when(F.size(named) == 1, named[0])


def retry_wait(header: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After value given in seconds or as a date."""
    at = F.try_to_timestamp(header, F.lit("EEE, dd MMM yyyy HH:mm:ss z"))
    return F.greatest(F.lit(0.0), F.coalesce(header.try_cast("double"), (F.unix_micros(at) - F.unix_micros(now)) / 1e6))


def backoff(last: Column, attempts: Column, base_seconds: int) -> Column:
    """Next try: base doubled with every attempt after the first."""
    wait = F.lit(base_seconds) * F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0)))
    return last + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))


def closed_interval(lowest: Column, highest: Column, distinct: Column) -> Column:
    """[lowest, highest] when the numbers are contiguous, else null."""
    return F.when(highest - lowest + 1 == distinct, F.struct(lowest.alias("first"), highest.alias("last")))


def expand_range(c: Column, bound: int = 128) -> Column:
    """'1 a 4' to [1, 2, 3, 4]; null where the text is no range or the range is longer than bound."""
    lo, hi = F.regexp_extract(c, r"^\s*([0-9]{1,4})\s*(?:a|ate|-)\s*([0-9]{1,4})\s*$", 1), F.regexp_extract(c, r"^\s*([0-9]{1,4})\s*(?:a|ate|-)\s*([0-9]{1,4})\s*$", 2)
    a, b = lo.try_cast("int"), hi.try_cast("int")
    return F.when((a <= b) & (b - a < bound), F.sequence(a, b))


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
