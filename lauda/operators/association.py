"""Answer-key association, catalogue registration and lineage: joins on declared identity.

Every pairing is an equi-join on a block; no operator compares all rows of a block that a finer key can
part. Null keys never match unless stated; repeated rows count once; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.functions.text import comparison_key

#: Least score of the older rule, most a shared title may add.
OLDER_MINIMUM, TITLE_BONUS = 36, 2


def candidates(exams: DataFrame, keys: DataFrame, core: list[str], scopes: str | None = None) -> DataFrame:
    """Pairs of exams (columns e_*) and active keys (k_*) that agree on every core field; where both sides name
    scopes (arrays), they must share one."""
    e, k = (d.withColumnsRenamed({c: f"{p}_{c}" for c in d.columns}) for d, p in ((exams, "e"), (keys.filter("active"), "k")))
    pairs = e.join(k, [F.col(f"e_{c}") == F.col(f"k_{c}") for c in core])
    if scopes is None:
        return pairs
    a, b = F.col(f"e_{scopes}"), F.col(f"k_{scopes}")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    return pairs.filter(none(a) | none(b) | F.arrays_overlap(a, b))


def older_choice(scored: DataFrame, key: str, candidate: str) -> DataFrame:
    """(key, n_best, outcome, chosen) by the older rule: the best score decides from OLDER_MINIMUM on; among
    equals the only definitive one, or the only one that names no other of them as its successor.

    scored: (key, candidate, score, phase, predecessor). Three aggregations, so a key with many candidates
    is reduced map-side.
    """
    top = scored.groupBy(key).agg(F.max("score").alias("_top"))
    best = scored.join(top, key).filter("score = _top")
    succeeded = best.select(key, F.col("predecessor").alias(candidate)).filter(f"{candidate} is not null").distinct().withColumn("_old", F.lit(True))
    rows = best.join(succeeded, [key, candidate], "left")
    only = lambda p: F.when(F.count_if(p) == 1, F.min(F.when(p, F.col(candidate))))
    per = rows.groupBy(key).agg(
        F.max("_top").alias("best_score"), F.count("*").alias("n_best"), F.min(candidate).alias("_one"),
        only(F.col("phase") == "definitive").alias("_definitive"), only(F.col("_old").isNull()).alias("_latest"),
    )
    chosen = F.when(F.col("best_score") >= OLDER_MINIMUM, F.when(F.col("n_best") == 1, F.col("_one")).otherwise(F.coalesce("_definitive", "_latest")))
    outcome = F.when(F.col("best_score") < OLDER_MINIMUM, "below_minimum").when(chosen.isNull(), "ambiguous").otherwise("selected")
    return per.select(key, "best_score", "n_best", outcome.alias("outcome"), chosen.alias("chosen"))


def blocked_pairs(left: DataFrame, right: DataFrame, block: list[str], tiers: list[list[str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, tier): partners inside a block by the first tier of keys that gives any.

    Each tier is an equi-join on block and tier keys of the rows that no earlier tier paired.
    """
    out, rest = [], left
    for n, keys in enumerate(tiers, 1):
        on = [*block, *keys]
        found = rest.join(right.select(*on, right_id).distinct(), on).select(left_id, right_id, F.lit(n).alias("tier"))
        out.append(found)
        rest = rest.join(found.select(left_id).distinct(), left_id, "left_anti")
    return reduce(DataFrame.unionByName, out).distinct()


def letter_map(own: Column, reference: Column) -> Column:
    """Map of own letter to the reference's letter of the same text; both are arrays of (letter, text). Texts
    that the reference lacks, or has twice, give no entry; of equal own letters the first counts."""
    keyed = lambda c: F.transform(c, lambda a: F.struct(a["letter"].alias("letter"), comparison_key(F.coalesce(a["text"], F.lit(""))).alias("k")))
    mine = F.filter(keyed(own), lambda a: a["letter"].isNotNull() & (a["k"] != ""))
    first = F.filter(mine, lambda a, n: F.array_position(F.transform(mine, lambda x: x["letter"]), a["letter"]) == n + 1)
    theirs = keyed(reference)
    hit = lambda a: F.filter(theirs, lambda r: r["k"] == a["k"])
    found = F.filter(first, lambda a: F.size(hit(a)) == 1)
    return F.map_from_entries(F.transform(found, lambda a: F.struct(a["letter"], F.element_at(hit(a), 1)["letter"])))


def audit(current: DataFrame, recommended: DataFrame, key: str, value: str) -> DataFrame:
    """(key, current, recommended, state) of an association before it is applied: confirmed, divergent,
    missing (nothing associated yet) or unsupported (nothing recommended)."""
    c = current.select(key, F.col(value).alias("current"))
    r = recommended.select(key, F.col(value).alias("recommended"))
    a, b = F.col("current"), F.col("recommended")
    state = F.when(a.isNull() & b.isNull(), "open").when(a.isNull(), "missing").when(b.isNull(), "unsupported").when(a == b, "confirmed").otherwise("divergent")
    return c.join(r, key, "full_outer").select(key, "current", "recommended", state.alias("state"))


def apply_audit(audited: DataFrame, replace: bool = False) -> DataFrame:
    """(key, value) after applying an audit: missing ones are filled, divergent ones only if replace says so."""
    key = audited.columns[0]
    take = F.col("state") == "missing"
    if replace:
        take = take | (F.col("state") == "divergent")
    return audited.select(key, F.when(take, F.col("recommended")).otherwise(F.col("current")).alias("value"))


def surrogate(*parts: Column) -> Column:
    """Stable key of a dimension row from its natural key; null and empty parts differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]), 256)


def register(rows: DataFrame, levels: list[str]) -> dict[str, DataFrame]:
    """Dimension tables of a hierarchy (contest, application, role ...): level name to (key, parent_key, name,
    n_rows). A level's key covers all levels above it; rows without a value stop there."""
    out = {}
    for n, level in enumerate(levels):
        above = levels[:n]
        seen = rows.filter(F.col(level).isNotNull()).groupBy(*above, level).agg(F.count("*").alias("n_rows"))
        parent = surrogate(*[F.col(c) for c in above]) if above else F.lit(None).cast("string")
        out[level] = seen.select(surrogate(*[F.col(c) for c in [*above, level]]).alias("key"), parent.alias("parent_key"), F.col(level).alias("name"), "n_rows")
    return out


def backfill(rows: DataFrame, known: DataFrame, digest: str, target: str) -> DataFrame:
    """rows with the one target that carries their digest and an outcome: mapped, ambiguous or unmapped; the
    last two go to review."""
    per = known.filter(F.col(digest).isNotNull() & F.col(target).isNotNull()).groupBy(digest).agg(F.count_distinct(target).alias("_n"), F.min(target).alias(target))
    n = F.coalesce("_n", F.lit(0))
    both = rows.join(per, digest, "left")
    return both.select(*rows.columns, F.when(n == 1, F.col(target)).alias(target), F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unmapped").alias("outcome"))


def reconcile(history: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """(on, state) of lineage edges recomputed after a correction: kept, archived (no longer there) or added."""
    old, new = history.select(*on).distinct().withColumn("_o", F.lit(1)), edges.select(*on).distinct().withColumn("_n", F.lit(1))
    state = F.when(F.col("_n").isNull(), "archived").when(F.col("_o").isNull(), "added").otherwise("kept")
    return old.join(new, on, "full_outer").select(*on, state.alias("state"))


def top_distinct(df: DataFrame, score: str, url: str, minimum: float, k: int) -> DataFrame:
    """The k rows of highest score from the minimum on, one per URL without its fragment, ties by URL."""
    bare = F.regexp_replace(url, "#.*$", "")
    one = df.filter(F.col(score) >= minimum).groupBy(bare.alias("url_key")).agg(F.max(F.struct(F.col(score), F.col(url))).alias("_b"))
    return one.select("url_key", F.col(f"_b.{score}").alias(score)).orderBy(F.desc(score), "url_key").limit(k)


def representatives(df: DataFrame, group: str, ranks: list[Column]) -> DataFrame:
    """One row per group, first by the given ranks; partial sums keep a hot group from moving row by row."""
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), F.struct(*[r.alias(f"_{n}") for n, r in enumerate(ranks)])).alias("_r")).select("_r.*")


def first_of_content(df: DataFrame, content: str, order: str) -> Column:
    """Whether a row is the first of its content: the deduplication dimension of a gate."""
    return F.row_number().over(Window.partitionBy(content).orderBy(order)) == 1
