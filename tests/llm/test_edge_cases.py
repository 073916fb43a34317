"""Every training-data query over edge-case tables: no crash, unique rows, results that stay the same."""

import pytest

from lauda.llm import queries
from lauda import queries_orphans
from tests.llm import edge_tables

ALL = {**queries.QUERIES, **queries_orphans.QUERIES}


@pytest.fixture(scope="module")
def dirs(tmp_path_factory, tiny):
    return {v: edge_tables.write(tiny, tmp_path_factory.mktemp(v), v) for v in ("empty", "nulls", "repeated", "long", "clashing")}


@pytest.fixture(scope="module")
def plain(spark, tiny):
    return {n: sorted(map(str, f(spark, tiny).collect())) for n, f in ALL.items() if n.endswith("_found")}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_empty_results(spark, dirs, name):
    rows = ALL[name](spark, dirs["empty"]).collect()
    assert rows == []


@pytest.mark.parametrize("variant", ["nulls", "long"])
@pytest.mark.parametrize("name", sorted(ALL))
def test_dirty_tables_do_not_crash(spark, dirs, name, variant):
    rows = list(map(str, ALL[name](spark, dirs[variant]).collect()))
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", [n for n in sorted(ALL) if n.endswith("_found")])
def test_clashing_columns_change_nothing(spark, dirs, plain, name):
    assert sorted(map(str, ALL[name](spark, dirs["clashing"]).collect())) == plain[name]


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p4_found", "p5_found", "p6_found", "p8_found"])
def test_repeated_rows_count_once(spark, dirs, plain, name):
    assert sorted(map(str, ALL[name](spark, dirs["repeated"]).collect())) == plain[name]
