"""Network edge as a plug-in: per-host pacing, robots rules, revalidation against a cache table.

There is no network here; a fetcher is given by the caller and runs in the tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lauda.functions import urls

#: url, etag or None -> (status, etag, body or None)
Fetcher = Callable[[str, str | None], tuple[int, str | None, bytes | None]]
RESULT = "url string, status int, etag string, body binary, attempts int, error string"


def allowed_by_robots(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (url) that no longer rule (host, prefix, allow) forbids: the longest matching prefix
    decides, and without one a page is allowed."""
    p = pages.withColumn("_host", urls.host(F.col("url"))).withColumn("_path", F.coalesce(F.parse_url(F.col("url"), F.lit("PATH")), F.lit("/")))
    hit = p.join(rules.select(F.col("host").alias("_host"), "prefix", "allow"), "_host").filter(F.expr("startswith(_path, prefix)"))
    verdict = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("_ok"))
    return p.join(verdict, "url", "left").filter(F.coalesce("_ok", F.lit(True))).drop("_host", "_path", "_ok")


def fetch(pages: DataFrame, cache: DataFrame, fetcher: Fetcher, pause: float = 1.0, retries: int = 2) -> DataFrame:
    """Fetch (url) with one host per task at a time: rows are partitioned by host, which keeps the pause
    between two requests to it; a 304 answer keeps the cached body."""
    known = cache.select("url", F.col("etag").alias("_etag"), F.col("body").alias("_body"))
    rows = pages.select("url", urls.host(F.col("url")).alias("host")).join(known, "url", "left")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in it:
            out = []
            for url, host, etag, body in zip(pdf["url"], pdf["host"], pdf["_etag"], pdf["_body"]):
                error, status, tag, got, n = None, None, None, None, 0
                for n in range(1, retries + 2):
                    time.sleep(max(0.0, last.get(host, 0.0) + pause - time.monotonic()))
                    last[host] = time.monotonic()
                    try:
                        status, tag, got = fetcher(url, etag)
                        error = None
                        if status < 500:
                            break
                    except Exception as e:  # a failed request is a row
                        error = f"{type(e).__name__}: {e}"[:300]
                out.append((url, status, tag or etag, body if status == 304 else got, n, error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return rows.repartition("host").sortWithinPartitions("host", "url").mapInPandas(run, RESULT)
