"""URL identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters of analytics.
TRACKING = ["fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "yclid", "_ga"]
#: Query parameters of temporary signatures.
SIGNED = [
    "sig", "signature", "token", "access_token", "x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires",
    "x-amz-security-token", "x-amz-signature", "x-amz-signedheaders", "se", "sp", "sr", "st", "sv", "skoid", "sktid", "skt", "ske", "sks", "skv",
]


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", n)


def _params(url: Column) -> Column:
    q = _part(url, 4)
    return F.filter(F.split(q, "&"), lambda p: p != "")


def _name(p: Column) -> Column:
    return F.lower(F.substring_index(p, "=", 1))


def is_signed(url: Column) -> Column:
    """Whether an HTTP(S) URL carries a temporary signature."""
    return F.lower(_part(url, 1)).isin("http", "https") & F.exists(_params(url), lambda p: _name(p).isin(SIGNED))


def host(url: Column) -> Column:
    """Lower-case host without credentials and port; null when the URL is none."""
    h = F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", ""))
    return F.when(h != "", F.rtrim(h, F.lit(".")))


def canonical(url: Column) -> Column:
    """Stable identity: lower scheme and host, default port, doubled slashes, fragment, tracking and
    signed parameters gone, the rest of the query sorted. Null for anything but plain HTTP(S)."""
    scheme, net = F.lower(_part(url, 1)), _part(url, 2)
    port = F.regexp_extract(net, ":([0-9]+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(_part(url, 3), "/{2,}", "/")
    kept = F.array_sort(F.filter(_params(url), lambda p: ~_name(p).isin(TRACKING + SIGNED) & ~_name(p).startswith("utm_")))
    kept = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    return F.when(
        scheme.isin("http", "https") & host(url).isNotNull() & ~net.contains("@"),
        F.concat(
            scheme, F.lit("://"), host(url), F.when(default, "").otherwise(F.concat(F.lit(":"), port)),
            F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
        ),
    )


def redact(url: Column) -> Column:
    """The URL without signed parameters."""
    kept = F.filter(_params(url), lambda p: ~_name(p).isin(SIGNED))
    base, fragment = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1), F.regexp_extract(F.trim(url), r"(#.*)$", 1)
    return F.when(
        F.lower(_part(url, 1)).isin("http", "https"), F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), fragment)
    ).otherwise(F.trim(url))


def redact_in_text(c: Column) -> Column:
    """Signed parameters removed from the URLs inside a text."""
    names = "|".join(n.replace("-", "\\-") for n in SIGNED)
    t = F.regexp_replace(c, rf"(?i)([?&])(?:{names})=[^&\s\"'<>#]*", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"([?&])&+", "$1"), r"[?&]+(?=[\s\"'<>#]|$)", "")
    return t


def in_allowlist(url: Column, hosts: list[str]) -> Column:
    """Exact host or one of its subdomains."""
    h = host(url)
    ok = F.lit(False)
    for a in hosts:
        ok = ok | (h == a.lower()) | h.endswith("." + a.lower())
    return F.coalesce(ok, F.lit(False))


def is_safe_link(url: Column) -> Column:
    """HTTP(S) and no login, admin or account page."""
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & ~F.lower(_part(url, 3)).rlike(r"/(login|logout|signin|admin|wp-admin|account|conta|entrar)(/|$|\.)"), F.lit(False))
