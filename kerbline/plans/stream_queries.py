"""Streams with state: the events arrive in parts, out of order, and the job stops and goes on between the parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.registry import query, table
from kerbline.session import scratch
from kerbline.streaming import ordered

PARTS = 3
STATE_PARTS = 8

#: What the watermark has passed at the end: all but the last ten minutes.
_CLOSED = "closed AS (SELECT user_id AS key, event_id AS token, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events WHERE epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events))"


def _replayed(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each event reaches the stream up to eight minutes late, in one of the parts by its arrival; the job is started anew for each."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    arrival = F.unix_seconds("ts") + F.col("event_id") % 9 * 60
    span = events.agg(F.min(arrival).alias("low"), (F.max(arrival) - F.min(arrival) + 1).alias("width"))
    parts = events.crossJoin(F.broadcast(span)).withColumn("part", F.floor((arrival - F.col("low")) * PARTS / F.col("width"))).drop("low", "width")
    source, target, notes = (scratch(spark, f"stream-{n}") for n in ("source", "target", "notes"))
    own = ordered.state_session(spark, STATE_PARTS)
    for i in range(PARTS):
        parts.where(F.col("part") == i).drop("part").write.mode("append").parquet(source)
        ordered.drain(operator(own.readStream.schema(events.schema).parquet(source)), target, notes)
    return spark.read.parquet(target)


@query(
    "stream_count_windows",
    f"""WITH {_CLOSED}, w AS (SELECT key, idx AS start, token AS first_token, last_value(token) OVER a AS last_token, sum(value) OVER a AS total, count(*) OVER a AS n FROM closed WINDOW a AS (PARTITION BY key ORDER BY idx ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING))
SELECT key, start, first_token, last_token, round(total, 4) AS total FROM w WHERE n = 14 AND start % 4 = 0""",
)
def stream_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replayed(spark, sf_dir, lambda rows: ordered.ordered_count_windows(rows, "user_id", "ts", "event_id", "value", 14, 4))
    return found.withColumn("total", F.round("total", 4))


@query(
    "stream_sliding_mean",
    f"""WITH {_CLOSED}, w AS (SELECT key, idx, token, avg(value) OVER a AS m, count(*) OVER a AS n FROM closed WINDOW a AS (PARTITION BY key ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT key, idx, token, round(m + 1e-7, 3) AS mean FROM w WHERE n = 20""",
)
def stream_sliding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _replayed(spark, sf_dir, lambda rows: ordered.ordered_sliding_mean(rows, "user_id", "ts", "event_id", "value", 20))
    return found.withColumn("mean", F.round(F.col("mean") + 1e-7, 3))
