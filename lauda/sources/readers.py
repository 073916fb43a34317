"""Sources: JSON, TOML, HTML pages, sitemaps, feeds, archives, binary files, plug-in text extraction."""

from __future__ import annotations

import gzip
import io
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lauda.operators import parsers


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON with a declared schema; rows that don't fit come with _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def toml_table(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """One row per entry of a TOML array of tables: configuration, read by the driver."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    rows = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(section, [])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Links of stored HTML pages, in their order, with the section heading above them."""
    return parsers.expand(pages, key, html, parsers.links, parsers.LINK_SCHEMA)


def page_metadata(html, labels: list[str]) -> dict:
    """Column per label: the text after 'label:' in the tag-free page."""
    from lauda.functions.text import squeeze

    plain = squeeze(F.regexp_replace(html, "<[^>]+>", "\n"))
    return {x: F.nullif(F.trim(F.regexp_extract(plain, rf"(?i)\b{x}\s*:\s*([^:]{{1,80}}?)(?=\s+\w+\s*:|$)", 1)), F.lit("")) for x in labels}


def _sitemap(body: str) -> list[tuple]:
    import xml.etree.ElementTree as et

    root = et.fromstring(body)
    kind = "index" if root.tag.endswith("sitemapindex") else "urlset"
    return [(n, kind, (e.text or "").strip()) for n, e in enumerate((x for x in root.iter() if x.tag.endswith("loc")), 1)]


def sitemaps(df: DataFrame, key: str, body: str) -> DataFrame:
    return parsers.expand(df, key, body, _sitemap, "ordinal int, kind string, url string")


def _feed(body: str) -> list[tuple]:
    import xml.etree.ElementTree as et

    out, seen = [], set()
    for e in et.fromstring(body).iter():
        name = e.tag.rsplit("}", 1)[-1]
        if name in ("item", "entry"):
            title = next((c.text for c in e if c.tag.rsplit("}", 1)[-1] == "title"), None)
            for c in e:
                n = c.tag.rsplit("}", 1)[-1]
                url = c.get("href") or c.get("url") or (c.text or "").strip() if n in ("link", "enclosure") else None
                if url and url not in seen:
                    seen.add(url)
                    out.append((len(out) + 1, url, title))
    return out


def feeds(df: DataFrame, key: str, body: str) -> DataFrame:
    """RSS or Atom entries, the first of equal URLs."""
    return parsers.expand(df, key, body, _feed, "ordinal int, url string, title string")


def json_items(df: DataFrame, body: str, items_path: str, fields: dict[str, str]) -> DataFrame:
    """Items of a JSON API answer: dotted path to the list, dotted path per field, the page cursor left
    in place for the caller."""
    doc = F.try_parse_json(F.col(body))
    items = F.try_variant_get(doc, f"$.{items_path}", "array<variant>")
    one = df.select("*", F.posexplode(items).alias("ordinal", "_item"))
    return one.select(*df.columns, "ordinal", *[F.try_variant_get("_item", f"$.{p}", "string").alias(n) for n, p in fields.items()])


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Local or remote files with their digest and size."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size_bytes"))


MAX_MEMBERS, MAX_TOTAL, MAX_RATIO = 200, 256 * 1024 * 1024, 200


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, content, problem): members of ZIP files one row each; unsafe ones only as a
    problem (traversal, encryption, too many, too large, too compressed)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        total = 0
                        for n, m in enumerate(i for i in z.infolist() if not i.is_dir()):
                            total += m.file_size
                            parts = m.filename.replace("\\", "/").split("/")
                            why = (
                                "too many members" if n >= MAX_MEMBERS else "unsafe path" if ".." in parts or m.filename.startswith("/") else "encrypted" if m.flag_bits & 1
                                else "too large" if total > MAX_TOTAL else "ratio" if m.file_size > MAX_RATIO * max(1, m.compress_size) else None
                            )
                            out.append((path, m.filename, None if why else z.read(m), why))
                except zipfile.BadZipFile:
                    out.append((path, None, None, "no archive"))
            yield pd.DataFrame(out, columns=["path", "member", "content", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, problem string")


def gunzip_bounded(data: bytes, limit: int = 64 * 1024 * 1024) -> bytes | None:
    """Decompressed bytes, or None beyond the limit."""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        out = f.read(limit + 1)
    return None if len(out) > limit else out


#: A text extractor: bytes of one document to its page texts.
Extractor = Callable[[bytes], list[str]]


def extract_pages(files: DataFrame, extractor: Extractor) -> DataFrame:
    """(path, page_number, text, error) by a plugged-in extractor; a failing document gives one error row."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(path, n, t, None) for n, t in enumerate(extractor(content), 1)]
                except Exception as e:  # an unreadable document is a row, not a failed job
                    out.append((path, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Documents of which under half the pages have text."""
    ok = F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    return pages.groupBy("path").agg(F.count("*").alias("n_pages"), ok.alias("n_text")).withColumn("needs_ocr", F.col("n_text") < F.greatest(F.lit(1.0), F.col("n_pages") / 2))


def frontier(start: DataFrame, follow: Callable[[DataFrame], DataFrame], cap: int, rounds: int) -> DataFrame:
    """Breadth-first pages (url) from start: `follow` gives the links of a frontier; seen pages and
    those beyond the cap are left out. One job per depth, the state in written tables."""
    from lauda.session import materialize

    seen = materialize(start.select("url").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, rounds + 1):
        fresh = follow(seen.filter(F.col("depth") == d - 1)).select("url").distinct().join(seen, "url", "left_anti")
        room = cap - seen.count()
        fresh = materialize(fresh.orderBy("url").limit(max(0, room)).withColumn("depth", F.lit(d)), "frontier")
        if not fresh.limit(1).count():
            break
        seen = materialize(seen.unionByName(fresh), "frontier")
    return seen
