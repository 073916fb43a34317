"""Exact and near-duplicate grouping of question occurrences, with provenance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

BOUNDARY = ["contest_id", "application_id", "role_id", "stage_id", "shift_id", "content_kind"]


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key, the first in order, with the number of copies."""
    d = df.withColumn("_k", key)
    rest = df.columns
    return d.groupBy("_k").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_f"), F.count("*").alias("n_copies")).select(*[F.col(f"_f.{c}").alias(c) for c in rest], "n_copies")


def claims(df: DataFrame, digest: Column, at: str, origin: str) -> DataFrame:
    """First and last sight per digest and how many origins brought it."""
    return df.groupBy(digest.alias("digest")).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("n_sightings"), F.count_distinct(origin).alias("n_origins")
    )


def within_document(df: DataFrame, doc: str, number: str, text: str, order: str) -> DataFrame:
    """One row per (document, number): equal texts merge, else the longest wins with a note."""
    return df.groupBy(doc, number).agg(
        F.min_by(text, F.struct(-F.length(text), F.col(order))).alias(text),
        F.count("*").alias("n_rows"),
        (F.count_distinct(text) > 1).alias("had_conflict"),
    )


#: Similarity from which alternatives are equal, strong, weak with traces of damage; an answer's closest text.
EQUAL, STRONG, WEAK, CLOSEST = 0.90, 0.94, 0.72, 0.90
#: Share of the longer text that a contained one makes up (broken line, other damage).
HELD_BROKEN, HELD = 0.25, 0.45
#: Least letters of the shorter text (broken line, other damage), growth that shows damage, least alternatives.
LETTERS_BROKEN, LETTERS, GROWTH, GROWTH_CHARS, ALTERNATIVES = 5, 8, 1.35, 18, 4


@dataclass(frozen=True)
class Alternative:
    """One alternative as it is compared: its words, its letters and digits alone, whether a line breaks in it."""

    shown: str
    bare: str
    broken: bool

    @classmethod
    @lru_cache(maxsize=1 << 16)
    def of(cls, text: str) -> "Alternative":
        flat = unicodedata.normalize("NFKD", text.casefold())
        return cls(" ".join(text.casefold().split()), "".join(filter(str.isalnum, flat)), "\n" in text)

    def closeness(self, other: "Alternative") -> float:
        if self.bare == other.bare:
            return float(bool(self.bare))
        if not (self.bare and other.bare):
            return 0.0
        return max(SequenceMatcher(None, x, y).ratio() for x, y in ((self.shown, other.shown), (self.bare, other.bare)))

    def damaged_form_of(self, other: "Alternative", score: float, alternatives: int) -> bool:
        """Whether a weak pair may be one alternative that extraction broke or let run on."""
        size, full = sorted((len(self.bare), len(other.bare)))
        inside = self.bare in other.bare or other.bare in self.bare
        held = size / full if size and inside else 0.0
        broken = self.broken or other.broken
        if broken and held >= HELD_BROKEN and size >= LETTERS_BROKEN:
            return True
        traced = broken or full - size >= GROWTH_CHARS and full >= GROWTH * size
        return traced and alternatives >= ALTERNATIVES and size >= LETTERS and (held >= HELD or score >= WEAK)


def _cheapest(cost: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of least total cost (Hungarian method, cubic time)."""
    n = len(cost)
    u, v, row, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row[0], j0 = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while row[j0]:
            used[j0] = True
            i0 = row[j0]
            for j in range(1, n + 1):
                if not used[j] and (c := cost[i0 - 1][j - 1] - u[i0] - v[j]) < least[j]:
                    least[j], way[j] = c, j0
            j1 = min((j for j in range(1, n + 1) if not used[j]), key=least.__getitem__)
            delta = least[j1]
            for j in range(n + 1):
                if used[j]:
                    u[row[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            row[j0] = row[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row[j] - 1] = j - 1
    return out


def best_assignment(m: list[list[float]]) -> list[int]:
    """Most strong pairs, then the best worst pair, then the sum, without trying all assignments."""
    n = len(m)

    def at_least(floor: float) -> tuple[int, list[int]]:
        """Strong pairs of the best assignment by strong pairs and sum; -1 when it needs a pair below the floor."""
        o = _cheapest([[-(x >= STRONG) * (n + 1) - x if x >= floor else (n + 2.0) ** 2 for x in r] for r in m])
        return (sum(m[i][j] >= STRONG for i, j in enumerate(o)) if all(m[i][j] >= floor for i, j in enumerate(o)) else -1), o

    floors = sorted({x for r in m for x in r})
    most, best = at_least(floors[0])
    low, high = 0, len(floors) - 1
    while low < high:
        mid = (low + high + 1) // 2
        strong, o = at_least(floors[mid])
        if strong == most:
            low, best = mid, o
        else:
            high = mid - 1
    return best


def alignment(left: list[str], right: list[str]) -> list[tuple[int, int, float]]:
    """(left, right, closeness) of the best assignment of alternatives, in polynomial time for any number of
    them; empty where the numbers differ."""
    if not left or len(left) != len(right):
        return []
    grid = [[x.closeness(y) for y in map(Alternative.of, right)] for x in map(Alternative.of, left)]
    return [(i, j, grid[i][j]) for i, j in enumerate(best_assignment(grid))]


def alternatives_score(left: list[str], right: list[str]) -> float:
    """Least similarity over the best assignment of alternatives."""
    return min((s for _, _, s in alignment(left, right)), default=0.0)


def alternatives_compatible(left: list[str], right: list[str]) -> bool:
    """All alternatives equal, or all strong but the weakest, which may be damaged in extraction."""
    by_score = sorted(alignment(left, right), key=lambda p: p[2])
    if not by_score or by_score[0][2] >= EQUAL:
        return bool(by_score)
    if len(by_score) > 1 and by_score[1][2] < STRONG:
        return False
    i, j, score = by_score[0]
    return Alternative.of(left[i]).damaged_form_of(Alternative.of(right[j]), score, len(by_score))


def mapped_answer(answer: str | None, own: list[str], reference: list[str]) -> str | None:
    """Bare text of the reference's alternative that an answer text stands for.

    The answer's own alternative leads through the alignment; an answer that is none of its question's
    alternatives goes to the closest one of the reference, and stays itself where none is close.
    """
    if not answer or not (mine := Alternative.of(answer)).bare:
        return None
    position = next((n for n, t in enumerate(own) if Alternative.of(t).bare == mine.bare), None)
    target = {i: j for i, j, _ in alignment(own, reference)}.get(position)
    if target is not None:
        return Alternative.of(reference[target]).bare
    near = max(((mine.closeness(Alternative.of(t)), Alternative.of(t).bare) for t in reference), default=(0.0, ""))
    return near[1] if near[0] >= CLOSEST else mine.bare


@F.pandas_udf(StringType())
def mapped_answers(answer: pd.Series, own: pd.Series, reference: pd.Series) -> pd.Series:
    """mapped_answer of every row; null lists count as empty."""
    full = lambda x: [t or "" for t in x] if x is not None else []
    return pd.Series([mapped_answer(a, full(x), full(y)) for a, x, y in zip(answer, own, reference)], dtype=object)


def answer_consensus(members: DataFrame, group: str, representative: DataFrame) -> DataFrame:
    """(group, n_answers, n_values, outcome, answer_text): do a group's members, whose alternatives may stand in
    another order, name the same answer?

    members: (group, answer_text, alts); representative: (group, rep_alts), one row per group. Equal
    (answer, alternatives) of a group are mapped once. agreed, conflict, or missing without any answer.
    """
    one = members.groupBy(group, "answer_text", "alts").agg(F.count("*").alias("_n"))
    mapped = one.join(representative, group).select(group, "_n", mapped_answers("answer_text", "alts", "rep_alts").alias("_v"))
    per = mapped.groupBy(group, "_v").agg(F.sum("_n").alias("_n")).groupBy(group).agg(
        F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("n_answers"), F.count("_v").alias("n_values"), F.min("_v").alias("_v")
    )
    outcome = F.when(F.col("n_values") == 0, "missing").when(F.col("n_values") == 1, "agreed").otherwise("conflict")
    return per.select(group, F.coalesce("n_answers", F.lit(0)).alias("n_answers"), "n_values", outcome.alias("outcome"), F.when(F.col("n_values") == 1, F.col("_v")).alias("answer_text"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; null where either side is null."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Least similarity over the best assignment of two lists of alternatives."""
    return pd.Series([0.0 if x is None or y is None else alternatives_score(list(x), list(y)) for x, y in zip(a, b)])


def exact_units(df: DataFrame, boundary: list[str], statement_key: str, content_key: str, booklet: str) -> DataFrame:
    """One row per exact content inside a boundary, with its booklets: copies collapse before any
    comparison, so a bucket of one content is a single row however many occurrences it has."""
    return df.groupBy(*boundary, statement_key, content_key).agg(
        F.min("id").alias("unit_id"), F.count("*").alias("n_occurrences"), F.collect_set(booklet).alias("booklets"), F.min_by("alts", "id").alias("alts")
    )


def complete_linkage(units: list[tuple[str, list[str], set[str]]]) -> list[list[int]]:
    """Clusters of units (id, alternatives, booklets) in the given order: the first free unit gathers every
    later free one that is compatible with all it has gathered. Each pair is compared once at most."""
    free = list(range(len(units)))
    out = []
    while free:
        seed, *others = free
        cluster, books, free = [seed], set(units[seed][2]), []
        for n in others:
            if books.isdisjoint(units[n][2]) and all(alternatives_compatible(units[m][1], units[n][1]) for m in cluster):
                cluster.append(n)
                books |= units[n][2]
            else:
                free.append(n)
        out.append(cluster)
    return out


def near_clusters(units: DataFrame, boundary: list[str], statement_key: str, content_key: str = "unit_id") -> DataFrame:
    """(unit_id, cluster_id): greedy complete-linkage clusters of units with one statement inside one
    boundary, taken in the order of their content key; the cluster is named by its smallest unit.

    Units of one booklet never meet, nor do units with different numbers of alternatives, which lie in
    buckets of their own. Buckets of one unit, nearly all, never leave the JVM; the others are streamed
    sorted through one ordered pass, a bucket at a time.
    """
    bucket = [*boundary, statement_key, "_size"]
    sized = units.withColumn("_size", F.coalesce(F.size("alts"), F.lit(0)))
    counts = sized.groupBy(*[F.col(c).alias(f"_b_{c}") for c in bucket]).agg(F.count("*").alias("_n"))
    marked = sized.join(counts, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in bucket]).select(*sized.columns, "_n")
    single = marked.filter("_n = 1").select("unit_id", F.col("unit_id").alias("cluster_id"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, list[str], set[str]]] = []
        last = None

        def done() -> pd.DataFrame:
            rows = [(held[n][0], min(held[m][0] for m in c)) for c in complete_linkage(held) for n in c]
            return pd.DataFrame(rows, columns=["unit_id", "cluster_id"])

        for pdf in it:
            for key, uid, alts, books in zip(pdf["_key"], pdf["unit_id"], pdf["alts"], pdf["booklets"]):
                if key != last and held:
                    yield done()
                    held = []
                last = key
                held.append((uid, [t or "" for t in alts] if alts is not None else [], set(books) if books is not None else set()))
        if held:
            yield done()

    many = marked.filter("_n > 1").select(F.sha2(F.to_json(F.struct(*bucket)), 256).alias("_key"), F.col(content_key).alias("_content"), "unit_id", "alts", "booklets")
    multi = many.repartition("_key").sortWithinPartitions("_key", "_content", "unit_id").select("_key", "unit_id", "alts", "booklets").mapInPandas(run, "unit_id string, cluster_id string")
    return single.unionByName(multi)


def provenance(df: DataFrame, key: str, order: str, origin: list[str]) -> DataFrame:
    """One row per key with the number of provenances and the first of them."""
    return df.groupBy(key).agg(F.count("*").alias("n_provenances"), F.count_distinct(*origin).alias("n_distinct"), F.min_by(F.struct(*origin), order).alias("_f")).select(
        key, "n_provenances", "n_distinct", *[F.col(f"_f.{c}").alias(f"first_{c}") for c in origin]
    )


def propagate_fields(members: DataFrame, group: str, representative: DataFrame, fields: list[str]) -> DataFrame:
    """Blank fields of members taken from the group's representative."""
    rep = representative.select(group, *[F.col(f).alias(f"_{f}") for f in fields])
    return members.join(rep, group, "left").withColumns({f: F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.col(f"_{f}")) for f in fields}).drop(*[f"_{f}" for f in fields])


def recover(df: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """The value of highest priority, unless that priority holds different ones."""
    top = df.groupBy(key).agg(F.max(priority).alias(priority))
    best = df.join(top, [key, priority])
    return best.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v")).select(key, F.when(F.col("_n") == 1, F.col("_v")).alias(value))


def supersession_heads(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Heads of chains node -> predecessor: nodes nobody names as predecessor."""
    return nodes.join(edges.select(F.col("predecessor").alias("node")).filter("node is not null").distinct(), "node", "left_anti")


def chain_depth(edges: DataFrame) -> DataFrame:
    """(node, root, depth) of predecessor chains by pointer doubling: a chain of length L takes log2 L
    joins. Nodes on a cycle, or whose chain leaves the table, get a null root and depth; of several rows of
    a node the smallest predecessor counts; rows without a node take no part.

    Every round resolves some node of each unfinished chain, so when a round resolves none, what is left
    runs into a cycle.
    """
    from lauda.session import materialize, release

    first = edges.filter("node is not null").groupBy("node").agg(F.min("predecessor").alias("up"))
    known = first.select(F.col("node").alias("up"), F.lit(True).alias("_in"))
    there = F.col("_in").isNotNull()
    cur = first.join(known, "up", "left").select(
        "node", F.when(there, F.col("up")).alias("up"), there.cast("bigint").alias("depth"), (F.col("up").isNotNull() & ~there).alias("dangling"), F.coalesce(F.when(there, F.col("up")), F.col("node")).alias("root")
    )
    cur, before = materialize(cur, "chain"), None
    while (live := cur.filter("up is not null").count()) and live != before:
        ahead = cur.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("dangling").alias("g2"), F.col("root").alias("r2"))
        running = cur.filter("up is not null").join(ahead, "up").select(
            "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("g2").alias("dangling"), F.col("r2").alias("root")
        )
        last, before = cur, live
        cur = materialize(cur.filter("up is null").unionByName(running), "chain")
        release(last)
    whole = F.col("up").isNull() & ~F.col("dangling")
    return cur.select("node", F.when(whole, F.col("root")).alias("root"), F.when(whole, F.col("depth")).alias("depth"))
