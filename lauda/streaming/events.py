"""Structured Streaming forms: telemetry windows, retry state, incremental intake."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def telemetry(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type and window, late rows dropped behind the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Redelivered events once, state bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


RETRY_OUT = "item string, attempts int, status string, next_at timestamp"
RETRY_STATE = "attempts int"


def retry_machine(outcomes: DataFrame, maximum: int, base_seconds: int) -> DataFrame:
    """Outcomes (item, failed, at) to retry decisions; only the number of attempts is kept per item."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out: list[tuple[Any, ...]] = []
        rows = pd.concat(list(pdfs)).sort_values("at")
        for failed, at in zip(rows["failed"], rows["at"]):
            n = n + 1 if failed else 0
            status = "exhausted" if n >= maximum else "waiting" if n else "done"
            out.append((key[0], n, status, at + pd.Timedelta(seconds=base_seconds * 2 ** (n - 1)) if status == "waiting" else pd.NaT))
        if n and n < maximum:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["item", "attempts", "status", "next_at"])

    return outcomes.groupBy("item").applyInPandasWithState(step, RETRY_OUT, RETRY_STATE, "append", GroupStateTimeout.NoTimeout)


def intake(stream: DataFrame, target: str, checkpoint: str):
    """Append what has arrived since the last run, then stop: resumable by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
