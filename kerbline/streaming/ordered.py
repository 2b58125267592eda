"""Count windows and sliding means over streams whose rows come late and out of order.

Rows wait in list state until the watermark has passed them; an event-time timer then releases them in order of time and
token, so the rows of a key are numbered as a batch job would number them.  Beside what waits, a key's state is the last
n - 1 rows and one counter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_ROW = "at long, token long, value double"


def _place(row: tuple) -> tuple:
    """Order of the rows of a key: time, then token, a null token first."""
    at, token, _ = row
    return at, token is not None, token or 0


def _plain(frame: pd.DataFrame) -> list[tuple]:
    columns = [frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("at", "token", "value")]
    return [(int(a), None if t is None else int(t), v) for a, t, v in zip(*columns, strict=True)]


@dataclass
class InOrder(StatefulProcessor):
    """Hands the rows of a key on in order, with the n - 1 before them; subclasses say what a stretch gives."""

    n: int

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getListState("last", _ROW)
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = _plain(frame)
            if new:
                self.waiting.appendList(new)
                low = min(at for at, _, _ in new)
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        """One timer a key, at its earliest waiting row."""
        due, ours = at // 1000, list(self.handle.listTimers())
        if not ours or due < min(ours):
            for t in ours:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ready, later = [], []
        for row in self.waiting.get():
            (ready if row[0] // 1000 <= until else later).append(tuple(row))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(at for at, _, _ in later) // 1000)
        else:
            self.waiting.clear()
        ready.sort(key=_place)
        before = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else 0
        stretch = before + ready
        keep = stretch[max(0, len(stretch) - (self.n - 1)) :]
        if keep:
            self.last.put(keep)
        self.seen.update((seen + len(ready),))
        if len(stretch) >= self.n:
            yield self.stretch(key[0], stretch, seen - len(before))

    def stretch(self, key, rows: list[tuple], start: int) -> pd.DataFrame:
        """Rows of the answer for every n rows in a row; start is the number of the first."""
        raise NotImplementedError

    def sums(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the values that are not null, for each n rows in a row."""
        values = np.array([np.nan if v is None else v for _, _, v in rows])
        ahead = np.lib.stride_tricks.sliding_window_view(values, self.n)
        return np.nansum(ahead, axis=1), np.count_nonzero(~np.isnan(ahead), axis=1)

    def close(self) -> None:
        pass


@dataclass
class CountWindows(InOrder):
    hop: int

    def stretch(self, key, rows, start):
        totals, counts = self.sums(rows)
        at = [i for i in range(len(totals)) if (start + i) % self.hop == 0]
        return pd.DataFrame(
            {
                "key": [key] * len(at),
                "start": [start + i for i in at],
                "first_token": [rows[i][1] for i in at],
                "last_token": [rows[i + self.n - 1][1] for i in at],
                "total": [float(totals[i]) if counts[i] else None for i in at],
            },
            dtype=object,
        )


@dataclass
class SlidingMean(InOrder):
    def stretch(self, key, rows, start):
        totals, counts = self.sums(rows)
        means = [float(t / c) if c else None for t, c in zip(totals, counts, strict=True)]
        return pd.DataFrame({"key": [key] * len(means), "idx": [start + self.n - 1 + i for i in range(len(means))], "token": [r[1] for r in rows[self.n - 1 :]], "mean": means}, dtype=object)


def _run(events: DataFrame, key: str, time: str, token: str, value: str, late: str, processor: InOrder, answer: str) -> DataFrame:
    kind = events.select(F.col(key)).schema[0].dataType.simpleString()
    rows = events.where(F.col(time).isNotNull()).select(
        F.col(key).alias("key"), F.col(time).cast("timestamp").alias("time"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(token).cast("long").alias("token"), F.col(value).cast("double").alias("value")
    )
    return rows.withWatermark("time", late).groupBy("key").transformWithStateInPandas(processor, f"key {kind}, {answer}", "Append", "EventTime")


def ordered_count_windows(events: DataFrame, key: str, time: str, token: str, value: str, n: int, hop: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Windows of n consecutive rows of a key, every hop-th row a start (hop = n: tumbling); those that are full.

    Rows of a key are ordered by time, then token (null tokens first).  Rows without a time have no place and are left
    out; rows later than the watermark are dropped by Spark; a null key is a key; null values don't count in totals, a
    window of nulls has a null total.
    """
    return _run(events, key, time, token, value, late, CountWindows(n, hop or n), "start long, first_token long, last_token long, total double")


def ordered_sliding_mean(events: DataFrame, key: str, time: str, token: str, value: str, n: int, late: str = "10 minutes") -> DataFrame:
    """Mean of the last n values of a key at every row, once there are n; order and nulls as for the count windows."""
    return _run(events, key, time, token, value, late, SlidingMean(n), "idx long, token long, mean double")


def state_session(spark: SparkSession, partitions: int) -> SparkSession:
    """A session beside the given one for queries with list state and timers: RocksDB holds the state, which is cut into a
    stated number of parts for the query's whole life."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def drain(answer: DataFrame, target: str, notes: str) -> None:
    """Take all that is there now, append what is final to parquet files, stop; called again it goes on from its notes."""
    answer.writeStream.format("parquet").option("path", target).option("checkpointLocation", notes).outputMode("append").trigger(availableNow=True).start().awaitTermination()
