"""Sinks: JSON lines, packages with their exceptions and manifest, idempotent staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    """Compact sorted-key objects, one per line; the commit protocol makes it all or nothing."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_package(df: DataFrame, path: str, exportable: Column) -> DataFrame:
    """questions and exceptions side by side plus a manifest row with counts and a content hash that
    doesn't depend on row order."""
    rows = df.withColumn("_ok", F.coalesce(exportable, F.lit(False)))
    write_json_lines(rows.filter("_ok").drop("_ok"), f"{path}/questions")
    write_json_lines(rows.filter("not _ok").drop("_ok"), f"{path}/exceptions")
    manifest = package_manifest(df, exportable)
    write_json_lines(manifest, f"{path}/manifest")
    return manifest


def package_manifest(df: DataFrame, exportable: Column) -> DataFrame:
    """Preview of a package: nothing is written."""
    ok = F.coalesce(exportable, F.lit(False))
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.agg(
        F.count_if(ok).alias("n_exported"), F.count_if(~ok).alias("n_exceptions"), F.sum(F.when(ok, F.xxhash64(line).cast("decimal(20,0)"))).cast("string").alias("content_sum")
    )


def stage_jdbc(batch: DataFrame, existing: DataFrame, key: list[str], url: str, table: str, properties: dict[str, str], dry_run: bool = True) -> int:
    """Append the rows whose key isn't staged yet; a dry run only counts them."""
    new = batch.join(existing.select(*key), key, "left_anti")
    n = new.count()
    if not dry_run and n:
        new.write.jdbc(url, table, mode="append", properties=properties)
    return n


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def latest_import(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Latest row per external key, nulls last, combined map-side."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), F.col(at), F.col(tie))).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def render_markdown(rows: list[dict], title: str) -> str:
    """A small collected table as Markdown; rows in given order."""
    if not rows:
        return f"# {title}\n\n(no rows)\n"
    cols = list(rows[0])
    body = "\n".join("| " + " | ".join("" if r[c] is None else str(r[c]) for c in cols) + " |" for r in rows)
    return f"# {title}\n\n| {' | '.join(cols)} |\n|{'|'.join(' --- ' for _ in cols)}|\n{body}\n"
