"""Set operators with their integrity checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_distinct_ids(parts: list[DataFrame], key: str) -> DataFrame:
    """Union that fails when a key occurs twice: the check runs where the rows are written."""
    u = reduce(DataFrame.unionByName, parts)
    n = F.count("*").over(Window.partitionBy(key))
    return u.withColumn(key, F.when(n > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string")))).otherwise(F.col(key)))


def union_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key).distinct(), key, "left_semi")


def dedupe_either_key(df: DataFrame, source: str, order: str, first_key: str, second_key: str) -> DataFrame:
    """Keep a row unless one of its keys was seen on an earlier kept row of the source.

    A dropped row registers neither key, so this is sequential inside a source. Rows whose two keys
    are both unique in the source are kept in parallel; only the rest (key repeats) goes through an
    ordered pass, one task per source.
    """
    n1 = F.count("*").over(Window.partitionBy(source, first_key))
    n2 = F.count("*").over(Window.partitionBy(source, second_key))
    marked = df.withColumn("_solo", (n1 == 1) & (n2 == 1))
    cols = df.columns

    def ordered(it):
        import pandas as pd

        seen_a: set = set()
        seen_b: set = set()
        last = object()
        for pdf in it:
            keep = []
            for s, a, b in zip(pdf[source], pdf[first_key], pdf[second_key]):
                if s != last:
                    seen_a, seen_b, last = set(), set(), s
                ok = a not in seen_a and b not in seen_b
                if ok:
                    seen_a.add(a)
                    seen_b.add(b)
                keep.append(ok)
            yield pdf[pd.Series(keep, index=pdf.index)]

    rest = marked.filter("not _solo").select(*cols).repartition(source).sortWithinPartitions(source, order)
    return marked.filter("_solo").select(*cols).unionByName(rest.mapInPandas(ordered, df.schema))


def merge_catalog(df: DataFrame, path: list[str], provenance: str) -> DataFrame:
    """One row per path with the sorted distinct provenances."""
    return df.groupBy(*path).agg(F.array_join(F.array_sort(F.collect_set(provenance)), "|").alias("provenances"), F.count("*").alias("n_rows"))
