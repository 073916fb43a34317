"""Canonical JSON and content-derived identities, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lauda.functions import text as t


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def sha256_json(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def statement_fingerprint(statement: Column) -> Column:
    """Identity of the statement alone, tolerant of spacing and punctuation."""
    return F.sha2(t.comparison_key(t.question_text(statement)), 256)


def exact_fingerprint(statement: Column, texts: Column) -> Column:
    """Identity of statement and alternatives in their order."""
    return sha256_json(statement=t.question_text(statement), alternatives=F.transform(texts, t.alternative_text))


def invariant_fingerprint(statement: Column, texts: Column) -> Column:
    """Identity of statement and alternatives in any order."""
    return sha256_json(statement=t.question_text(statement), alternatives=F.array_sort(F.transform(texts, t.alternative_text)))


def decision_fingerprint(content: Column, status: Column, answer: Column) -> Column:
    """Identity of what a reviewer decided on: content, answer status, answer."""
    return sha256_json(content=content, status=status, answer=answer)


def pages_fingerprint(texts: Column) -> Column:
    """Document hash from the hashes of its ordered pages."""
    return F.sha2(F.array_join(F.transform(texts, lambda p: F.sha2(t.page_text(p), 256)), "\n"), 256)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


#: The URL namespace of RFC 4122.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
