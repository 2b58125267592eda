"""The reference planner as a chain: forecast, proposals, simulation, scores, the best one, its extension, an emergency brake.

A planner call is one row: its ego state and the lead vehicle along its path.  Places are along the path (x) and beside
it (y, to the left).  Everything but the tracker is columns; the tracker runs over the few rows of a token's proposals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators import planning, scoring
from kerbline.session import cut

#: When the brake takes over, and its limits.
BRAKE = {"time": 2.0, "speed": 5.0, "accel": 2.40, "decel": -4.05}
#: Ego speed below which nothing counts as a coming collision, and the look-aheads in steps.
STOPPED, LOOK_AHEAD = 0.005, (0, 3, 6, 9)
LENGTH, WIDTH, LEAD_LENGTH, LEAD_WIDTH = 4.5, 2.0, 4.5, 2.0


def ttc_fold(contacts: DataFrame, by: list[str], dt: float = 0.1, red_light: str = "red_light") -> DataFrame:
    """(by, ttc, first_time) from contacts with projected ego boxes.

    contacts: by, object, t, ahead (look-ahead step), speed (of the ego vehicle at t), in_front, initially_hit.  Contacts
    of a standing vehicle, with red-light areas or with what was touched at the start don't count.  In the order of time
    and look-ahead, a contact that is not in front makes its object ignored from then on; one in front is an infraction.
    """
    known = contacts.where(~F.startswith("object", F.lit(red_light)) & ~F.col("initially_hit") & (F.col("speed") >= STOPPED))
    found = scoring.counted_faults(known.withColumn("_order", F.struct("t", "ahead")), [*by, "object"], "_order", "in_front")
    first = F.min(F.when(F.col("counts"), F.col("t")))
    folded = found.groupBy(*by).agg(first.alias("_first"))
    every = contacts.select(*by).distinct().join(folded, by, "left")
    return every.select(*by, F.when(F.col("_first").isNull(), 1.0).otherwise(0.0).alias("ttc"), F.coalesce(F.col("_first") * dt, F.lit(float("inf"))).alias("first_time"))


def brake_speed(speed: Column, accel: Column) -> Column:
    """Speed at which the brake path goes on: a proportional brake above 0.2 m/s, a stop with damping below."""
    clip = lambda u: F.greatest(F.least(u, F.lit(BRAKE["accel"])), F.lit(BRAKE["decel"]))
    return F.when(speed > 0.2, 1.1 * (speed + clip(-10.0 * speed))).otherwise(clip(-4.0 * speed - accel))


def brake_path(starts: DataFrame, steps: int = 40, dt: float = 0.1) -> DataFrame:
    """(token, t, x, y, heading) of the brake.  starts: token, x, y, heading, speed, accel."""
    ahead = starts.withColumn("_v", brake_speed(F.col("speed"), F.col("accel"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    way = F.col("_v") * F.col("t") * dt
    return ahead.select("token", "t", (F.col("x") + way * F.cos("heading")).alias("x"), (F.col("y") + way * F.sin("heading")).alias("y"), "heading")


def with_emergency_brake(plans: DataFrame, starts: DataFrame, infractions: DataFrame, steps: int = 40, dt: float = 0.1) -> DataFrame:
    """plans (token, t, x, y, heading), those of slow vehicles with an infraction close ahead replaced by the brake path.  infractions: (token, first_time)."""
    brakes = infractions.where(F.col("first_time") <= BRAKE["time"]).select("token").join(starts.where(F.col("speed") <= BRAKE["speed"]).select("token"), "token")
    return plans.join(brakes, "token", "left_anti").unionByName(brake_path(starts.join(brakes, "token", "left_semi"), steps, dt).select(*plans.columns))


def extended(starts: DataFrame, winners: DataFrame, since: int = 40, steps: int = 50, dt: float = 0.1) -> DataFrame:
    """Steps `since` + 1 to `steps` of the winning proposal, unrolled as the proposals were.  winners: (token, proposal)."""
    own = starts.join(winners.select("token", "proposal"), "token")
    return planning.unroll_proposals(own, steps=steps, dt=dt, only="proposal").where(F.col("t") > since)


def lead_place(t: Column, dt: float) -> Column:
    """Place of the lead vehicle's middle after t steps, by lead_gap and lead_speed."""
    return F.col("lead_gap") + (LENGTH + LEAD_LENGTH) / 2 + F.col("lead_speed") * t * dt


def forecast_lead(starts: DataFrame, steps: int = 50, dt: float = 0.1) -> DataFrame:
    """(token, t, lead_x): the lead vehicle's middle at a constant speed, from the ego vehicle's middle at t = 0."""
    ahead = starts.select("token", "lead_gap", "lead_speed", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("t"))
    return ahead.select("token", "t", lead_place(F.col("t"), dt).alias("lead_x"))


def closed_loop(starts: DataFrame, steps: int = 40, dt: float = 0.1) -> DataFrame:
    """(token, proposal, score, ttc, first_time) of every proposal: simulated by the tracker, scored against the forecast.

    starts: token, speed, accel, limit, lead_gap, lead_speed.
    """
    driven = planning.drive_proposals(starts.select("token", "speed", "limit", "lead_gap", "lead_speed"), steps, dt)
    # boxes are near parallel to the path: they meet where both gaps close
    beside = F.abs("y") <= (WIDTH + LEAD_WIDTH) / 2
    near = lambda x, t: (F.abs(lead_place(t, dt) - x) <= (LENGTH + LEAD_LENGTH) / 2) & beside
    now = driven.groupBy("token", "proposal").agg(
        F.when(F.max(near(F.col("x"), F.col("t")).cast("int")) == 1, 0.0).otherwise(1.0).alias("collision"),
        F.max("x").alias("progress"),
        (F.max(F.abs("acceleration")) < 4.89).cast("double").alias("comfort"),
    )
    there = driven.withColumn("ahead", F.explode(F.array(*map(F.lit, LOOK_AHEAD)))).withColumn("_at", F.col("t") + F.col("ahead"))
    moved = F.col("x") + F.col("speed") * F.cos("heading") * F.col("ahead") * dt
    contacts = there.select("token", "proposal", F.lit("lead").alias("object"), "t", "ahead", "speed", (lead_place(F.col("_at"), dt) > F.col("x")).alias("in_front"), F.lit(False).alias("initially_hit"), near(moved, F.col("_at")).alias("_hit")).where("_hit")
    ttc = ttc_fold(contacts, ["token", "proposal"], dt)
    both = now.join(ttc, ["token", "proposal"], "left").withColumn("ttc", F.coalesce("ttc", F.lit(1.0))).withColumn("first_time", F.coalesce("first_time", F.lit(float("inf"))))
    scored = scoring.normalised_progress(both.withColumnRenamed("progress", "raw"), "raw", F.col("collision"), "token")
    terms = [(F.col(n), scoring.WEIGHTS[n]) for n in ("progress", "ttc", "comfort")]
    return scored.select("token", "proposal", scoring.gated_score([F.col("collision")], terms).alias("score"), "ttc", "first_time")


def plan(starts: DataFrame, steps: int = 40, longer: int = 50, dt: float = 0.1) -> DataFrame:
    """(token, t, x, y, heading) of the best proposal, unrolled to `longer` steps, or of the brake path where an infraction is close and the vehicle slow."""
    # a row a call, read by every branch below; dealt out, as the calls are few and each is much work
    starts = cut(starts)
    starts = starts.repartition(int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    best = F.max_by(F.struct("proposal", "first_time"), F.struct(F.col("score"), -F.col("proposal")))
    winners = cut(closed_loop(starts, steps, dt).groupBy("token").agg(best.alias("b")).select("token", "b.*"))
    unrolled = extended(starts, winners, 0, longer, dt)
    poses = unrolled.select("token", "t", F.col("s").alias("x"), F.col("offset").alias("y"), F.lit(0.0).alias("heading"))
    at = starts.select("token", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"), "speed", "accel")
    return with_emergency_brake(poses, at, winners.select("token", "first_time"), longer, dt)


def last_step(rows: DataFrame, by: str, time: str) -> DataFrame:
    """The row of each group with the largest time."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(time)))).where("_rn = 1").drop("_rn")
