import datetime
import random

from lauda.operators import orphans as o

T = datetime.datetime


def _targets(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at timestamp, deleted_at timestamp")


def _refs(spark, rows):
    return spark.createDataFrame(rows, "id string, created_at timestamp, ingested_at timestamp, target string")


REF = o.Reference("t", "target", "s", "ingested_at")


def test_reasons(spark):
    targets = _targets(spark, [("a", T(2024, 1, 1), None), ("gone", T(2023, 1, 1), T(2024, 1, 5)), ("late", T(2025, 1, 1), None), ("nodate", None, None)])
    rows = [
        ("1", T(2024, 2, 1), T(2024, 2, 1), " A "), ("2", T(2024, 2, 1), T(2024, 2, 1), "GONE"), ("3", T(2024, 1, 4), T(2024, 2, 1), "gone"), ("4", T(2024, 2, 1), T(2024, 2, 1), "late"),
        ("5", T(2024, 2, 1), T(2024, 2, 1), "never"), ("6", None, None, "never"), ("7", T(2024, 2, 1), T(2024, 2, 1), "  "), ("8", T(2024, 2, 1), T(2024, 2, 1), None),
        ("9", T(2024, 2, 1), T(2024, 2, 1), "never"), ("9", T(2024, 2, 1), T(2024, 3, 1), "a"), ("10", T(2000, 1, 1), None, "nodate"), ("11", T(2024, 1, 5), None, "gone"),
    ]
    got = {(r.record_id, r.reason, r.ref_period) for r in o.orphan_records(o.references(_refs(spark, rows), REF), o.fold_deltas(o.target_deltas(targets, "s"))).collect()}
    assert got == {("2", "deleted", "2024-02"), ("4", "late", "2024-02"), ("5", "missing", "2024-02"), ("6", "missing", None), ("11", "deleted", "2024-01")}


def test_counts_kept_by_deltas_equal_recomputed_counts(spark):
    r1 = o.references(_refs(spark, [("1", T(2024, 1, 1), None, "x"), ("2", T(2024, 1, 1), None, "x"), ("3", T(2024, 1, 1), None, "y")]), REF)
    r2 = o.references(_refs(spark, [("4", T(2024, 1, 1), None, "z")]), REF)
    state = o.fold_deltas(o.reference_deltas(r1))
    state = o.apply_deltas(state, o.target_deltas(_targets(spark, [("x", T(2024, 1, 1), None)]), "s"))
    state = o.apply_deltas(state, o.reference_deltas(r2))
    state = o.apply_deltas(state, o.reference_deltas(r1.filter("record_id = '3'"), -1))
    assert {(r.ref_key, r.n_refs) for r in o.orphan_keys(state).collect()} == {("z", 1)}


def test_empty(spark):
    got = o.orphan_records(o.references(_refs(spark, []), REF), o.fold_deltas(o.target_deltas(_targets(spark, []), "s")))
    assert got.collect() == []


def test_deltas_by_period_give_the_records_of_the_whole(spark):
    """Deletions, late arrivals and references given up, against brute force over the whole history."""
    r = random.Random(3)
    day = lambda: T(2021, 1, 1) + datetime.timedelta(days=r.randrange(1400))
    made = [(f"k{n}", day() if r.random() < 0.9 else None) for n in range(60)]
    targets = [(k, c, (c or T(2021, 1, 1)) + datetime.timedelta(days=r.randrange(900)) if r.random() < 0.4 else None) for k, c in made]
    rows = []
    for n in range(400):
        at, key = day() if r.random() < 0.95 else None, "k0" if r.random() < 0.3 else f" K{r.randrange(70)} "
        rows.append((f"r{n}", at, at or day(), key))
        if r.random() < 0.3:  # delivered again with another reference, or none
            rows.append((f"r{n}", at, (at or T(2024, 1, 1)) + datetime.timedelta(days=400), r.choice([None, "k3", f"k{r.randrange(70)}"])))
    last = {}
    for i, at, ver, key in rows:
        if i not in last or ver > last[i][1]:
            last[i] = (at, ver, (key or "").strip().lower())
    life = {k: (c, d) for k, c, d in targets}
    expected = set()
    for i, (at, _, key) in last.items():
        if key:
            born, gone = life.get(key, (None, None))
            reason = "missing" if key not in life else None if at is None else "late" if born and born > at else "deleted" if gone and gone <= at else None
            if reason:
                expected.add((i, reason))
    df, t = _refs(spark, rows), _targets(spark, targets)
    suspects, state = o.follow(o.references(df, REF), o.superseded(df, REF), o.target_deltas(t, "s"))
    got = [(x.record_id, x.reason) for x in o.orphan_records(suspects, state.current()).collect()]
    assert set(got) == expected and len(got) == len(expected) and {x for _, x in expected} == {"missing", "late", "deleted"}
    counts = {x.ref_key: x.n_refs for x in o.orphan_keys(state.current()).collect()}
    alive = {k for k, (_, d) in life.items() if d is None}
    now = [key for _, _, key in last.values() if key and key not in alive]
    assert counts == {k: now.count(k) for k in set(now)}


def test_order_of_batches_does_not_matter(spark):
    deltas = [
        o.target_deltas(_targets(spark, [("x", T(2024, 1, 1), None), ("y", T(2023, 1, 1), T(2024, 6, 1))]), "s"),
        o.reference_deltas(o.references(_refs(spark, [("1", T(2024, 1, 1), None, "x"), ("2", T(2024, 1, 1), None, "y"), ("3", T(2024, 1, 1), None, "z")]), REF)),
        o.reference_deltas(o.references(_refs(spark, [("3", T(2024, 1, 1), None, "z")]), REF), -1),
    ]
    seen = set()
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        state = o.OrphanState(spark, kind="timestamp")
        for n in order:
            state.append(deltas[n])
        seen.add(tuple(sorted(map(str, state.current().collect()))))
        assert {(x.ref_key, x.n_refs, x.reason) for x in o.orphan_keys(state.current()).collect()} == {("y", 1, "deleted")}
        state.drop()
    assert len(seen) == 1
