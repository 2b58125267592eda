"""Simulation and planning operators, run on pseudo-poses made of the events table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.operators import fits, planning
from kerbline.registry import frames, poses, query, r6, table
from kerbline.session import scratch
from kerbline.streaming import windows


@query(
    "savgol_deriv",
    """WITH {frames}, c AS (SELECT log, idx, value, count(*) OVER (PARTITION BY log) AS n FROM frames), w AS (SELECT *, lag(value, 2) OVER o AS a, lag(value) OVER o AS b, lead(value) OVER o AS d, lead(value, 2) OVER o AS e FROM c WINDOW o AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round((-2 * a - b + d + 2 * e) / 10 / 0.5e0, 5) + 0e0 AS slope FROM w WHERE idx BETWEEN 2 AND n - 3""",
)
def savgol_deriv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).select("log", "idx", "value")
    done = planning.savgol(own, "log", "idx", "value", 5, 2, 1, 0.5)
    sizes = own.groupBy("log").count()
    return done.join(sizes, "log").where("idx BETWEEN 2 AND count - 3").select("log", "idx", (F.round("smoothed", 5) + 0.0).alias("slope"))


def _fit_sql(window: int) -> str:
    """Least squares by Cramer's rule over the joined window of each row, its own position at 0."""
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    c0 = "(b0 * (s2 * s4 - s3 * s3) - s1 * (b1 * s4 - b2 * s3) + s2 * (b1 * s3 - b2 * s2))"
    c1 = "(s0 * (b1 * s4 - b2 * s3) - b0 * (s1 * s4 - s2 * s3) + s2 * (s1 * b2 - s2 * b1))"
    c2 = "(s0 * (s2 * b2 - s3 * b1) - s1 * (s1 * b2 - s2 * b1) + b0 * (s1 * s3 - s2 * s2))"
    return f"""SELECT {window} AS width, log, idx, round({c0} / {det} + 1e-7, 4) + 0e0 AS smoothed, round({c1} / {det} / 0.5e0 + 1e-7, 4) + 0e0 AS slope, round(2 * {c2} / {det} / 0.25e0 + 1e-7, 4) + 0e0 AS bend FROM (
SELECT a.log, a.idx, count(*) AS s0, sum(t) AS s1, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(y) AS b0, sum(t * y) AS b1, sum(t * t * y) AS b2 FROM (
SELECT a.log, a.idx, b.idx - a.idx AS t, b.value AS y FROM c a JOIN c b ON a.log = b.log AND b.idx >= least(greatest(a.idx - {window} // 2, 0), a.n - least(a.n, {window})) AND b.idx < least(greatest(a.idx - {window} // 2, 0), a.n - least(a.n, {window})) + least(a.n, {window})) a GROUP BY a.log, a.idx)"""


@query(
    "local_fits",
    "WITH {frames}, c AS (SELECT log, idx, value, count(*) OVER (PARTITION BY log) AS n FROM frames QUALIFY n > 2) " + " UNION ALL ".join(_fit_sql(w) for w in (5, 8, 15, 41)),
)
def local_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed values, slopes and bends of every frame, edges too, in odd, even and wide windows."""
    w = Window.partitionBy("log")
    own = frames(spark, sf_dir).select("log", "idx", "value").withColumn("n", F.count("*").over(w)).where("n > 2").drop("n")
    parts = []
    for width in (5, 8, 15, 41):
        both = fits.local_fits(own, "log", "idx", "value", width, 2, {"smoothed": 0, "slope": 1, "bend": 2}, 0.5)
        parts.append(both.select(F.lit(width).alias("width"), "log", "idx", *[(F.round(F.col(c) + 1e-7, 4) + 0.0).alias(c) for c in ("smoothed", "slope", "bend")]))
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "global_fits",
    """WITH {frames}, c AS (SELECT log, idx, value AS y, idx::DOUBLE AS t, count(*) OVER (PARTITION BY log) AS n FROM frames QUALIFY n > 2),
m AS (SELECT log, avg(t) AS mt, avg(y) AS my, var_pop(t) AS vt, covar_pop(t, y) AS cty, var_pop(t * t) AS vq, covar_pop(t * t, y) AS cqy, covar_pop(t * t, t) AS cqt, avg(t * t) AS mq FROM c GROUP BY log),
f AS (SELECT *, (cqy * vt - cty * cqt) / (vq * vt - cqt * cqt) AS b2, (cty * vq - cqy * cqt) / (vq * vt - cqt * cqt) AS b1 FROM m)
SELECT log, idx, round((b1 + 2 * b2 * t) / 0.5e0, 4) + 0e0 AS slope FROM c JOIN f USING (log)""",
)
def global_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of one fit for each whole series, at every frame."""
    w = Window.partitionBy("log")
    own = frames(spark, sf_dir).select("log", "idx", "value").withColumn("n", F.count("*").over(w)).where("n > 2").drop("n")
    return fits.global_fit(own, "log", "idx", "value", 2, 1, 0.5).select("log", "idx", (F.round("fitted", 4) + 0.0).alias("slope"))


@query(
    "idm_step",
    """WITH {poses}, s AS (SELECT token, abs(y) * 10 AS v, 15e0 AS target, 5 + idx AS gap, abs(heading) * 3 AS lead FROM poses),
w AS (SELECT *, greatest(1 + v * 1.5e0 + v * (v - lead) / (2 * sqrt(4.5e0)), 0) AS wish FROM s)
SELECT token, round(greatest(least(1.5e0 * (1 - power(v / target, 10) - power(wish / greatest(gap, 1), 2)), 1.5e0), -3), 6) + 0e0 AS acceleration FROM w""",
)
def idm_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    acceleration = planning.idm(F.abs("y") * 10, F.lit(15.0), F.col("idx") + 5.0, F.abs("heading") * 3)
    return poses(spark, sf_dir).select("token", r6(acceleration).alias("acceleration"))


@query(
    "bicycle_step",
    """WITH {poses}, s AS (SELECT token, x, y, heading AS h, value / 40 AS v, y AS a, heading / 10 AS st, heading AS ac, y AS sr FROM poses)
SELECT token, round(x + v * cos(h) * 0.1e0, 6) AS x, round(y + v * sin(h) * 0.1e0, 6) + 0e0 AS y, round(v + a * 0.1e0, 6) + 0e0 AS speed, round(a + 0.1e0 / (0.1e0 + 0.2e0) * (ac - a), 6) + 0e0 AS acceleration,
round(greatest(least(st + 0.1e0 / (0.1e0 + 0.05e0) * (st + sr * 0.1e0 - st), pi() / 3), -pi() / 3), 6) + 0e0 AS steering FROM s""",
)
def bicycle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = planning.bicycle(F.col("x"), F.col("y"), F.col("heading"), F.col("value") / 40, F.col("y"), F.col("heading") / 10, F.col("heading"), F.col("y"), 0.1)
    return poses(spark, sf_dir).select("token", *[r6(done[c]).alias(c) for c in ("x", "y", "speed", "acceleration", "steering")])


@query("lqr_step")
def lqr_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed loop over straight references at a speed of each log's own."""
    starts = poses(spark, sf_dir).where("idx = 0").select("token", (F.abs("y") * 10 + 1).alias("speed"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("t"))
    reference = starts.select("token", F.lit(0).alias("proposal"), "t", (F.col("speed") * F.col("t") * 0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"), "speed")
    return planning.simulate(reference)


@query("stream_replay", "SELECT date_trunc('hour', ts) AS start, user_id AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, taken to its end: windows of an hour per key, as the streaming operator leaves them."""
    kind = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(kind).parquet(f"{sf_dir}/event[s].parquet")
    path, notes = scratch(spark, "stream"), scratch(spark, "stream-state")
    counts = windows.event_time_counts(events.withColumnRenamed("user_id", "key").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "key", "1 hour")
    running = counts.writeStream.outputMode("complete").option("checkpointLocation", notes).trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    running.awaitTermination()
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "key", "n", F.round("total", 4).alias("total"))
