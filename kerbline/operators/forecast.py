"""Occupancy over time: objects moved on with their velocity, or as they were recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.scoring import nearest_k
from kerbline.operators.spatial import extrapolated

#: How many objects of each class are kept, nearest first.
CAPS = {"vehicle": 50, "pedestrian": 25, "bicycle": 10}
STATIC_CAP = 50


def constant_velocity_occupancy(objects: DataFrame, by: str, steps: int, every: int, dt: float, caps: dict[str, int] | None = None, static_cap: int = STATIC_CAP) -> DataFrame:
    """objects: by, track_token, type, distance, x, y, heading, vx, vy (null for static ones).
    Returns (by, t, track_token, x, y, heading) for t = 0, every, ... steps."""
    cap: Column = F.lit(0)
    for kind, n in (CAPS if caps is None else caps).items():
        cap = F.when(F.col("type") == kind, n).otherwise(cap)
    moving = nearest_k(objects.where("vx IS NOT NULL"), [by, "type"], "distance", "track_token", cap)
    still = nearest_k(objects.where("vx IS NULL"), [by], "distance", "track_token", F.lit(static_cap))
    both = moving.drop("rank").unionByName(still.drop("rank"))
    ahead = both.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps), F.lit(every))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    x, y, h = extrapolated(F.col("x"), F.col("y"), F.col("heading"), zero("vx"), zero("vy"), F.col("t") * dt)
    return ahead.select(by, "t", "track_token", x.alias("x"), y.alias("y"), h.alias("heading"))


def recorded_occupancy(objects: DataFrame, by: str, steps: int) -> DataFrame:
    """Recorded objects per step, each under the attributes of its first sighting; a token whose record is too short is an error.

    objects: by, t, track_token, type, x, y, heading.
    """
    first = objects.groupBy(by, "track_token").agg(F.min_by("type", "t").alias("type"))
    length = objects.groupBy(by).agg(F.max("t").alias("_last"))
    checked = objects.join(length, by).withColumn("_ok", F.when(F.col("_last") < steps, F.raise_error(F.lit("the record ends too early"))).otherwise(True)).where(F.col("_ok") & (F.col("t") <= steps))
    return checked.drop("type", "_last", "_ok").join(first, [by, "track_token"])


def initially_hit(pairs: DataFrame, red_light_within: Column, by: str) -> DataFrame:
    """Objects that touch the ego vehicle at the start; of red-light areas only those that it is wholly inside.  pairs: by, t, track_token."""
    is_light = F.startswith("track_token", F.lit("red_light_"))
    return pairs.where((F.col("t") == 0) & (~is_light | red_light_within)).select(by, "track_token").distinct()


def all_objects(static: DataFrame, moving: DataFrame, lights: DataFrame) -> DataFrame:
    """Static objects, moving ones and red-light areas as one table; columns that a class lacks are null."""
    return static.unionByName(moving, allowMissingColumns=True).unionByName(lights, allowMissingColumns=True)
