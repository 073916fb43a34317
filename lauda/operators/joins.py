"""Join shapes of the engine, each planned so that no side is broadcast without a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lauda.session import checked_broadcast


def left_chain(fact: DataFrame, *dims: tuple[DataFrame, str, str]) -> DataFrame:
    """Left joins to (dimension, fact key, dimension key); dimensions proven small are broadcast."""
    out = fact
    for d, fk, dk in dims:
        out = out.join(checked_broadcast(d), out[fk] == d[dk], "left").drop(d[dk]) if fk != dk else out.join(checked_broadcast(d), fk, "left")
    return out


def left_filtered(left: DataFrame, right: DataFrame, on: list[str], right_filter: Column) -> DataFrame:
    """Left join whose extra ON predicate concerns the right side only: filtered before the join."""
    return left.join(right.filter(right_filter), on, "left")


def exists(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def latest_value(left: DataFrame, right: DataFrame, on: list[str], value: str, at: str) -> DataFrame:
    """Correlated 'latest row wins' subquery as one aggregation and a left join."""
    last = right.groupBy(*on).agg(F.max_by(value, F.struct(at, value)).alias(value))
    return left.join(last, on, "left")


def gathered(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
    """Correlated array subquery: sorted distinct values per key."""
    return left.join(right.groupBy(*on).agg(F.array_sort(F.collect_set(value)).alias(value)), on, "left")


def either_key(events: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that match a key by any of several columns: one equi-join per column, no OR."""
    parts = [events.join(keys.select(F.col("key").alias(c)), c, "left_semi") for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def compare_versions(old: DataFrame, new: DataFrame, key: list[str], content: str) -> DataFrame:
    """Full outer comparison by key: added, removed, changed or unchanged."""
    a = old.select(*key, F.col(content).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.col(content).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def apply_answers(questions: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Answers (key, answer, annulled) applied to questions: matched, annulled, or missing with a note."""
    return questions.join(answers.select(*key, "answer", "annulled", F.lit(True).alias("_hit")), key, "left").withColumns(
        {
            "new_status": F.when(F.col("_hit").isNull(), "missing").when(F.col("annulled"), "annulled").otherwise("matched"),
            "new_answer": F.when(~F.col("annulled"), F.col("answer")),
            "note": F.when(F.col("_hit").isNull(), "not found in the key"),
        }
    ).drop("_hit", "answer", "annulled")


def in_interval(points: DataFrame, ranges: DataFrame, block: str, point: str, first: str, last: str, width: int = 16) -> DataFrame:
    """Points inside the closed intervals of their block, by buckets of a fixed width instead of a
    nested loop: every interval is listed in the buckets it touches."""
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return p.join(r, [block, "_b"]).filter(F.col(point).between(F.col(first), F.col(last))).drop("_b")


def contained_phrases(texts: DataFrame, phrases: DataFrame, words: int = 3) -> DataFrame:
    """(id, phrase_id, phrase) of phrases of up to `words` words contained in token texts, by n-gram
    equi-join: nothing is compared pair by pair, and n-grams are made only where a phrase's first word stands."""
    first = checked_broadcast(phrases.select(F.split("phrase", " ")[0].alias("_first")).distinct())
    runs = F.when(F.size("toks") > 0, F.transform(F.sequence(F.lit(1), F.size("toks")), lambda i: F.slice("toks", i, words)))
    starts = texts.select("id", F.explode(runs).alias("run")).withColumn("_first", F.col("run")[0]).join(first, "_first", "left_semi")
    grams = starts.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.array_join(F.slice("run", 1, n), " "))).alias("phrase")).distinct()
    return grams.join(checked_broadcast(phrases), "phrase")


def resolve_alias(rows: DataFrame, aliases: DataFrame, on: list[str]) -> DataFrame:
    """selected when one canonical key answers to the alias, ambiguous when several, else unknown."""
    per = aliases.groupBy(*on).agg(F.count_distinct("canonical").alias("_n"), F.min("canonical").alias("_one"))
    return rows.join(per, on, "left").withColumns(
        {
            "outcome": F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("selected"),
            "canonical": F.when(F.col("_n") == 1, F.col("_one")),
        }
    ).drop("_n", "_one")


def grid_check(expected: DataFrame, found: DataFrame, key: list[str], number: str) -> DataFrame:
    """Answer grid against question numbers, per key: extra numbers conflict, missing ones are incomplete."""
    e = expected.select(*key, number, F.lit(True).alias("_e")).distinct()
    f = found.select(*key, number, F.lit(True).alias("_f")).distinct()
    j = e.join(f, [*key, number], "full_outer")
    return j.groupBy(*key).agg(F.count_if(F.col("_e").isNull()).alias("n_extra"), F.count_if(F.col("_f").isNull()).alias("n_missing")).withColumn(
        "outcome", F.when(F.col("n_extra") > 0, "conflict").when(F.col("n_missing") > 0, "incomplete").otherwise("compatible")
    )


def paired(df: DataFrame, item: str, model: str, correct: str) -> DataFrame:
    """Wins, losses and ties of every two models over their common items."""
    a = df.select(item, F.col(model).alias("model_a"), F.col(correct).alias("_a"))
    b = df.select(item, F.col(model).alias("model_b"), F.col(correct).alias("_b"))
    return (
        a.join(b, item)
        .filter("model_a < model_b")
        .groupBy("model_a", "model_b")
        .agg(
            F.count("*").alias("n_items"),
            F.count_if(F.col("_a") & ~F.col("_b")).alias("wins_a"),
            F.count_if(~F.col("_a") & F.col("_b")).alias("wins_b"),
            F.count_if(F.col("_a") == F.col("_b")).alias("ties"),
        )
    )


def best_tier(pairs: DataFrame, key: str, tier: str) -> DataFrame:
    """Candidates of the first tier that has any, per key."""
    best = F.min(tier).over(Window.partitionBy(key))
    return pairs.withColumn("_t", best).filter(F.col(tier) == F.col("_t")).drop("_t")
