"""Queries by name, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.scenes import number_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frames and poses made of the events table: one log per user.  The SQL and the functions below say the same.
FRAMES_SQL = "frames AS (SELECT user_id AS log, event_id AS token, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
POSES_SQL = (
    FRAMES_SQL
    + ", poses AS (SELECT log, token, idx, event_type, value, idx + (token % 7) / 10e0 AS x, (token % 11) / 10e0 - 0.5e0 AS y, (token % 63) / 10e0 - 3.1e0 AS heading FROM frames)"
)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; sql may use {frames} and {poses} for the shared parts of its WITH clause."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("{frames}", FRAMES_SQL).replace("{poses}", POSES_SQL)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    own = events.select(F.col("user_id").alias("log"), F.col("event_id").alias("token"), "event_type", "value", "ts")
    return number_frames(own).withColumn("idx", F.col("idx").cast("long"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(
        "log",
        "token",
        "idx",
        "event_type",
        "value",
        (F.col("idx") + (F.col("token") % 7) / 10.0).alias("x"),
        ((F.col("token") % 11) / 10.0 - 0.5).alias("y"),
        ((F.col("token") % 63) / 10.0 - 3.1).alias("heading"),
    )


def r6(c: Column | str) -> Column:
    """Rounded as the SQL rounds; minus zero is zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
