"""Evidence-scored record linkage that reports ambiguity instead of guessing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Evidence:
    """One compared field: arrays of known values on both sides, empty or null where unknown."""

    name: str
    left: str
    right: str
    weight: int
    required: bool = False


def known(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def conflict(e: Evidence) -> Column:
    """Both sides known and disjoint."""
    a, b = F.col(e.left), F.col(e.right)
    return known(a) & known(b) & ~F.arrays_overlap(a, b)


def missing(e: Evidence) -> Column:
    return ~known(F.col(e.left)) | ~known(F.col(e.right))


def any_conflict(fields: list[Evidence]) -> Column:
    p = F.lit(False)
    for e in fields:
        p = p | conflict(e)
    return p


def assess(pairs: DataFrame, fields: list[Evidence], bonus: Column | None = None) -> DataFrame:
    """Add state (conflict, incomplete, comparable) and score of every pair."""
    score = bonus if bonus is not None else F.lit(0)
    lacking = F.lit(False)
    for e in fields:
        score = score + F.when(~missing(e) & ~conflict(e), e.weight).otherwise(0)
        if e.required:
            lacking = lacking | missing(e)
    return pairs.withColumns(
        {"state": F.when(any_conflict(fields), "conflict").when(lacking, "incomplete").otherwise("comparable"), "score": score.cast("int")}
    )


def decide(scored: DataFrame, key: str, candidate: str, minimum: int, margin: int) -> DataFrame:
    """One row per key: selected, ambiguous, below_minimum, incomplete, conflict, with the chosen candidate.

    The best score must reach the minimum and lead the runner-up by the margin; a tie never falls to
    chance. Best and runner-up come from one aggregation (the two largest scores), so a key with very
    many candidates is reduced map-side.
    """
    ok = F.col("state") == "comparable"
    top = F.max(F.when(ok, F.struct("score", candidate))).alias("_top")
    per = scored.groupBy(key).agg(
        top,
        F.count("*").alias("n_candidates"),
        F.count_if(ok).alias("n_comparable"),
        F.count_if(F.col("state") == "incomplete").alias("n_incomplete"),
    )
    joined = scored.filter(ok).join(per.select(key, F.col(f"_top.{candidate}").alias("_best")), key)
    second = joined.filter(F.col(candidate) != F.col("_best")).groupBy(key).agg(F.max("score").alias("_second"))
    lead = F.col("_top.score") - F.coalesce("_second", F.lit(-(10**6)))
    outcome = (
        F.when(F.col("n_comparable") == 0, F.when(F.col("n_incomplete") > 0, "incomplete").otherwise("conflict"))
        .when(F.col("_top.score") < minimum, "below_minimum").when(lead < margin, "ambiguous").otherwise("selected")
    )
    return per.join(second, key, "left").select(
        key, "n_candidates", "n_comparable", outcome.alias("outcome"), F.col("_top.score").alias("best_score"),
        F.when(outcome == "selected", F.col(f"_top.{candidate}")).alias("chosen"),
    )


def unique_best(scored: DataFrame, key: str, candidate: str, rank: list[Column]) -> DataFrame:
    """The one best candidate per key; equal ranks are ambiguous."""
    w = Window.partitionBy(key).orderBy(*rank)
    top = scored.withColumn("_r", F.rank().over(w)).filter("_r = 1")
    return top.groupBy(key).agg(F.count("*").alias("n_best"), F.min(candidate).alias("_one")).select(
        key, "n_best", F.when(F.col("n_best") == 1, "selected").otherwise("ambiguous").alias("outcome"), F.when(F.col("n_best") == 1, F.col("_one")).alias("chosen")
    )


def pools_in_order(decisions: list[DataFrame], key: str) -> DataFrame:
    """First pool with a row for the key wins (definitive before unknown before preliminary)."""
    out = decisions[0]
    for d in decisions[1:]:
        out = out.unionByName(d.join(out.select(key), key, "left_anti"))
    return out


#: Weight of each field that both sides know strongly, of equal intervals, of a definitive key.
KEY_WEIGHTS = {"board": 12, "concurso": 12, "year": 12, "organization": 8, "role": 10, "stage": 8, "turn": 8, "variant": 8}
INTERVAL_WEIGHT, DEFINITIVE_BONUS, KEY_MINIMUM, KEY_MARGIN = 12, 8, 82, 8
#: Fields without which a pair stays incomplete.
KEY_REQUIRED = ("board", "concurso", "year", "role", "stage", "turn", "variant")


def assess_keys(pairs: DataFrame) -> DataFrame:
    """State and score of pairs of an exam (columns e_*) and an answer key (columns k_*).

    Per field of KEY_WEIGHTS both sides have an array of values, null or empty where unknown, and a
    flag `_weak` where all evidence is weak; `e_interval` and `k_interval` are structs (first, last);
    `k_phase` is definitive, unknown or preliminary. Conflict: known strong sides are disjoint (roles:
    no common token set) or the intervals differ. Incomplete: a required field lacks strong evidence,
    or an interval lacks. Turns are asymmetric: a key without turns fits any exam, a key of one turn
    fits an exam without, a key of several turns leaves such an exam incomplete.
    """
    from lauda.functions.text import tokens, tokens_match

    bad, lacking, score = F.lit(False), F.lit(False), F.lit(0)
    for f, w in KEY_WEIGHTS.items():
        e, k = F.col(f"e_{f}"), F.col(f"k_{f}")
        e_ok, k_ok = known(e) & ~F.col(f"e_{f}_weak"), known(k) & ~F.col(f"k_{f}_weak")
        if f == "role":
            agree = F.exists(e, lambda x: F.exists(k, lambda y: (x == y) | tokens_match(tokens(x), tokens(y))))
        else:
            agree = F.arrays_overlap(e, k)
        both = e_ok & k_ok
        bad = bad | (both & ~F.coalesce(agree, F.lit(False)))
        if f == "turn":
            lacking = lacking | (known(k) & F.col(f"k_{f}_weak")) | (~e_ok & k_ok & (F.size(k) > 1))
        elif f in KEY_REQUIRED:
            lacking = lacking | ~both
        score = score + F.when(both & F.coalesce(agree, F.lit(False)), w).otherwise(0)
    ei, ki = F.col("e_interval"), F.col("k_interval")
    bad = bad | F.coalesce(ei != ki, F.lit(False))
    lacking = lacking | ei.isNull() | ki.isNull()
    score = score + F.when(ei == ki, INTERVAL_WEIGHT).otherwise(0) + F.when(F.col("k_phase") == "definitive", DEFINITIVE_BONUS).otherwise(0)
    return pairs.withColumns({"state": F.when(bad, "conflict").when(lacking, "incomplete").otherwise("comparable"), "score": score.cast("int")})


def select_keys(assessed: DataFrame, key: str, candidate: str) -> DataFrame:
    """One decision per exam: the definitive pool is judged first, then keys of unknown phase; only
    preliminary keys of sufficient score mean awaiting_definitive; ties and small leads are ambiguous."""
    fit = (F.col("state") == "comparable") & (F.col("score") >= KEY_MINIMUM)
    pool = F.when(fit & (F.col("k_phase") == "definitive"), 1).when(fit & (F.col("k_phase") == "unknown"), 2).when(fit, 3)
    rows = assessed.withColumn("_pool", pool)
    per = rows.groupBy(key).agg(F.min("_pool").alias("_best_pool"), F.count_if(F.col("state") == "incomplete").alias("_inc"), F.count_if(F.col("state") == "conflict").alias("_con"))
    in_pool = rows.join(per.select(key, "_best_pool"), key).filter("_pool = _best_pool and _pool < 3")
    top = in_pool.groupBy(key).agg(F.max(F.struct("score", candidate)).alias("_top"))
    second = in_pool.join(top, key).filter(F.col(candidate) != F.col(f"_top.{candidate}")).groupBy(key).agg(F.max("score").alias("_second"))
    j = per.join(top, key, "left").join(second, key, "left")
    lead = F.col("_top.score") - F.col("_second")
    outcome = (
        F.when(F.col("_best_pool").isNull(), F.when(F.col("_inc") > 0, "incomplete").when(F.col("_con") > 0, "conflict").otherwise("insufficient_evidence"))
        .when(F.col("_best_pool") == 3, "awaiting_definitive").when(lead < KEY_MARGIN, "ambiguous").otherwise("selected")
    )
    return j.select(key, outcome.alias("outcome"), F.when(outcome == "selected", F.col(f"_top.{candidate}")).alias("chosen"), F.col("_top.score").alias("best_score"), lead.alias("margin"))
