"""Streaming forms of the count window and the sliding mean (extensions: the batch operators have no unbounded input)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; windows close once the watermark has passed them."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def count_windows(events: DataFrame, key: str, n: int) -> DataFrame:
    """Every n-th event of a key gives a row with the sum of the last n: state per key is one count and one sum."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, total, chunk = state.get if state.exists else (0, 0.0, 0)
        out = []
        for pdf in frames:
            for v in pdf["value"]:
                count, total = count + 1, total + float(v)
                if count == n:
                    out.append((k[0], chunk, total))
                    count, total, chunk = 0, 0.0, chunk + 1
        state.update((count, total, chunk))
        yield pd.DataFrame(out, columns=["key", "chunk", "total"])

    kind = dict(events.dtypes)[key]
    return (
        events.select(F.col(key).alias("key"), "value")
        .groupBy("key")
        .applyInPandasWithState(step, f"key {kind}, chunk long, total double", "count long, total double, chunk long", "append", "NoTimeout")
    )
