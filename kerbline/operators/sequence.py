"""Ordered-sequence operators: differences, cumulative forms, gap filling, padding, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kerbline.functions.geometry import TWO_PI


def along(by: str | list[str], order: str | list[str]) -> WindowSpec:
    by, order = ([x] if isinstance(x, str) else x for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order)


def step_length(x: Column, y: Column, w: WindowSpec) -> Column:
    """Distance from the row before; 0 on the first."""
    return F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))


def cumulative(c: Column, w: WindowSpec) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def rolling_sum(c: Column, back: int, w: WindowSpec) -> Column:
    """Sum over the row and the `back` rows before it."""
    return F.sum(c).over(w.rowsBetween(-back, 0))


def phase_unwrap(rows: DataFrame, angle: str, by: str, order: str, name: str = "unwrapped") -> DataFrame:
    """Angle without jumps: full turns are counted from the rounded differences (half to even) and taken off."""
    w = along(by, order)
    turns = F.rint((F.col(angle) - F.lag(angle).over(w)) / TWO_PI)
    return rows.withColumn("_turns", F.coalesce(turns, F.lit(0.0))).withColumn(name, F.col(angle) - TWO_PI * cumulative(F.col("_turns"), w)).drop("_turns")


def forward_velocity(rows: DataFrame, columns: list[str], dt: float, by: str, order: str) -> DataFrame:
    """Difference to the next row over dt; the last row repeats the one before; 0 for a single row."""
    w = along(by, order)
    out = rows
    for c in columns:
        out = out.withColumn(f"_d_{c}", (F.lead(c).over(w) - F.col(c)) / dt)
    for c in columns:
        out = out.withColumn(f"v_{c}", F.coalesce(F.col(f"_d_{c}"), F.lag(f"_d_{c}").over(w), F.lit(0.0))).drop(f"_d_{c}")
    return out


def speed_and_acceleration(rows: DataFrame, dt: float, by: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """Finite differences: distance from the row before over dt, and its change over dt (null where there is none)."""
    w = along(by, order)
    speed = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / dt
    return rows.withColumn("speed", speed).withColumn("acceleration", (F.col("speed") - F.lag("speed").over(w)) / dt)


def heading_from_displacement(rows: DataFrame, by: str, order: str, eps: float, x: str = "x", y: str = "y", name: str = "heading_d") -> DataFrame:
    """Direction of travel from the row before (the origin for the first)."""
    w = along(by, order)
    dx = F.col(x) - F.lag(x, 1, 0.0).over(w)
    dy = F.col(y) - F.lag(y, 1, 0.0).over(w)
    return rows.withColumn(name, F.atan2(dy, dx + eps))


def fill_static(rows: DataFrame, value: str, moved: Column, by: str, order: str, name: str = "filled") -> DataFrame:
    """Where a step is too short to tell, the value of the nearest moving row before, else after, else 0."""
    w = along(by, order)
    seen = F.when(moved, F.col(value))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(name, F.coalesce(before, after, F.lit(0.0)))


def pad_forward(rows: DataFrame, column: str, steps: int, by: str, order: str) -> DataFrame:
    """For each row the next `steps` values: the log's last value, with mask 0, where the log has ended."""
    w = along(by, order)
    last = F.last(column).over(w.rowsBetween(0, Window.unboundedFollowing))
    ahead = rows.select("*", *[F.lead(column, k).over(w).alias(f"_f{k}") for k in range(1, steps + 1)], last.alias("_last"))
    return ahead.select(
        *rows.columns,
        *[F.coalesce(f"_f{k}", "_last").alias(f"f{k}") for k in range(1, steps + 1)],
        *[F.col(f"_f{k}").isNotNull().cast("int").alias(f"m{k}") for k in range(1, steps + 1)],
    )


def extrapolate_back(rows: DataFrame, column: str, by: str, order: str, name: str = "before") -> DataFrame:
    """The row before; where there is none, one step back along the first difference."""
    w = along(by, order)
    step = F.lead(column).over(w) - F.col(column)
    return rows.withColumn(name, F.coalesce(F.lag(column).over(w), F.col(column) - F.coalesce(step, F.lit(0.0))))


def stride(rows: DataFrame, start: int, step: int, idx: str = "idx") -> DataFrame:
    return rows.where((F.col(idx) >= start) & (F.pmod(F.col(idx) - start, F.lit(step)) == 0))


def sliding_mean(rows: DataFrame, value: str, n: int, by: str, order: str, name: str = "mean") -> DataFrame:
    """Mean of the last n rows, given only when there are n."""
    w = along(by, order).rowsBetween(-(n - 1), 0)
    return rows.withColumn(name, F.when(F.count(value).over(w) == n, F.avg(value).over(w)))


def refresh_every(rows: DataFrame, value: str, step: int, by: str, order: str, idx: str = "idx", name: str = "held") -> DataFrame:
    """The value as of the last refresh."""
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(F.col(idx) % step == 0, F.col(value)), ignorenulls=True).over(w))


def intervals(rows: DataFrame, time: str, values: list[str], by: str) -> DataFrame:
    """Bracketing pairs of neighbouring rows: t0, t1 and each value at both ends."""
    w = along(by, time)
    return rows.select(
        by, F.col(time).alias("t0"), F.lead(time).over(w).alias("t1"), *[F.col(v).alias(f"{v}0") for v in values], *[F.lead(v).over(w).alias(f"{v}1") for v in values]
    )


def interpolate(rows: DataFrame, time: str, values: list[str], by: str, step: int, start: Column | None = None) -> DataFrame:
    """Linear values on the grid of multiples of `step` that lie inside each row's interval; none outside the range.

    Each bracketing pair makes its own grid points, so there is no range join.
    """
    pairs = intervals(rows, time, values, by)
    low = F.ceil(F.col("t0") / step)
    high = F.when(F.col("t1").isNull(), F.floor(F.col("t0") / step)).otherwise(F.ceil(F.col("t1") / step) - 1)
    grid = pairs.withColumn("g", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    t = F.col("g") * step
    share = F.when(F.col("t1").isNull(), F.lit(0.0)).otherwise((t - F.col("t0")) / (F.col("t1") - F.col("t0")))
    return grid.select(by, t.alias("t"), *[(F.col(f"{v}0") + share * (F.coalesce(f"{v}1", f"{v}0") - F.col(f"{v}0"))).alias(v) for v in values])


def resample_clamped(rows: DataFrame, idx: str, values: list[str], by: str, every: float, until: float, dt: float) -> DataFrame:
    """Rows that lie at idx * every, on the grid dt, 2 dt, ... until; the origin is put before; ends are clamped."""
    steps = round(until / dt)
    own = rows.select(by, (F.col(idx) + 1).alias("k"), *values)
    origin = rows.select(by).distinct().select(by, F.lit(0).cast("long").alias("k"), *[F.lit(0.0).alias(v) for v in values])
    points = own.unionByName(origin)
    w = along(by, "k")
    pairs = points.select("*", *[F.coalesce(F.lead(v).over(w), F.col(v)).alias(f"{v}_n") for v in values], F.max("k").over(Window.partitionBy(by)).alias("last"))
    per = every / dt
    first, after = F.ceil(F.col("k") * per), F.ceil((F.col("k") + 1) * per) - 1
    stop = F.when(F.col("k") == F.col("last"), F.lit(steps).cast("long")).otherwise(F.least(after, F.lit(steps).cast("long")))
    first = F.greatest(first, F.lit(1).cast("long"))
    grid = pairs.withColumn("g", F.explode(F.when(stop >= first, F.sequence(first, stop)).otherwise(F.array().cast("array<bigint>"))))
    share = F.least(F.col("g") / per - F.col("k"), F.lit(1.0))
    return grid.select(by, F.col("g").alias("step"), *[(F.col(v) + share * (F.col(f"{v}_n") - F.col(v))).alias(v) for v in values])


def path_at(points: DataFrame, distances: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Points of a path at given arc lengths (clipped to the path).  points: by, s, values; distances: by, d."""
    ends = points.groupBy(by).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"))
    pairs = intervals(points, "s", values, by).where("t1 is not null")
    asked = distances.join(ends, by).withColumn("_d", F.least(F.greatest("d", "_lo"), F.col("_hi")))
    at = asked.join(pairs, by).where("_d >= t0 AND (_d < t1 OR (_d = _hi AND t1 = _hi))")
    share = F.coalesce(F.try_divide(F.col("_d") - F.col("t0"), F.col("t1") - F.col("t0")), F.lit(0.0))
    return at.select(by, "d", *[(F.col(f"{v}0") + share * (F.col(f"{v}1") - F.col(f"{v}0"))).alias(v) for v in values])


def history_indices(current: Column, n: int, ratio: int) -> Column:
    """current - (n - 1), ..., current by steps of ratio."""
    return F.sequence(current - (n - 1), current, F.lit(ratio).cast("long"))


def future_indices(horizon: float, dt: float, samples: int) -> list[int]:
    """Evenly spread indices over a horizon: whole intervals, divided by the samples."""
    n = int(horizon / dt) + 1
    step = n // samples
    return [step * (i + 1) for i in range(samples)]


def future_frames(rows: DataFrame, value: str, by: str, order: str, horizon: float, dt: float, samples: int) -> DataFrame:
    """(by, order, ahead, value): for each row what stands at the evenly spread future indices; those beyond the end go.  One sorted pass."""
    w = along(by, order)
    ahead = [F.struct(F.lit(k).alias("ahead"), F.lead(F.struct(value), k).over(w).alias("there")) for k in future_indices(horizon, dt, samples)]
    found = rows.select(by, order, F.array(*ahead).alias("_all")).select(by, order, F.inline("_all"))
    return found.where(F.col("there").isNotNull()).select(by, order, "ahead", F.col(f"there.{value}").alias(value))


def clamped_profile(profile: DataFrame, frames: DataFrame, by: str, idx: str, values: list[str]) -> DataFrame:
    """Frames joined to a profile whose last value holds on beyond its end."""
    last = profile.groupBy(by).agg(F.max(idx).alias("_last"))
    asked = frames.join(last, by).withColumn("_at", F.least(F.col(idx), F.col("_last")))
    return asked.join(profile.select(by, F.col(idx).alias("_at"), *values), [by, "_at"]).drop("_at", "_last")


def repair_jumps(headings: Column, valid: Column, limit: float = 1.5) -> Column:
    """A heading that jumps by more than the limit from the repaired one before takes that one's value."""
    start = F.array().cast("array<double>")

    def step(done: Column, z: Column) -> Column:
        before = F.when(F.size(done) > 0, F.element_at(done, -1))
        jump = z["v"] & (F.abs(z["h"] - before) > limit)
        return F.concat(done, F.array(F.when(F.coalesce(jump, F.lit(False)), before).otherwise(z["h"])))

    return F.aggregate(F.arrays_zip(headings.alias("h"), valid.alias("v")), start, step)


def path_between(points: DataFrame, by: str, low: Column, high: Column, values: list[str]) -> DataFrame:
    """Points of a path with arc length in [low, high]; both ends exactly where fewer than two points lie inside."""
    inside = points.where((F.col("s") >= low) & (F.col("s") <= high)).select(by, "s", *values)
    few = points.select(by).distinct().join(inside.groupBy(by).count(), by, "left").where(F.coalesce("count", F.lit(0)) < 2).select(by)
    ends = few.join(points.groupBy(by).agg(F.min(low).alias("_l"), F.min(high).alias("_h")), by).select(by, F.explode(F.array("_l", "_h")).alias("d"))
    cuts = path_at(points, ends, by, values).withColumnRenamed("d", "s").select(by, "s", *values)
    return inside.join(few, by, "left_anti").unionByName(cuts)


def to_grid(states: DataFrame, by: str, time: str, values: list[str], start: Column, dt: float, steps: int) -> DataFrame:
    """States at start + k * dt for k = 0 ... steps; times are clipped to each trajectory's range."""
    range_ = states.groupBy(by).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.min(start).alias("_start"))
    pairs = intervals(states, time, values, by).where("t1 IS NOT NULL").join(range_, by)
    # each pair makes its own grid points: from its begin on, up to where the next one begins; the first and last also those beyond the ends
    number = lambda t: F.ceil((F.col(t) - F.col("_start")) / dt - 1e-9)
    low = F.when(F.col("t0") == F.col("_t0"), 0).otherwise(F.greatest(number("t0"), F.lit(0)))
    high = F.when(F.col("t1") == F.col("_t1"), steps).otherwise(F.least(number("t1") - 1, F.lit(steps)))
    found = pairs.withColumn("k", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))
    found = found.withColumn("_t", F.least(F.greatest(F.col("_start") + F.col("k") * dt, F.col("_t0")), F.col("_t1")))
    share = (F.col("_t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return found.select(by, "k", *[(F.col(f"{v}0") + share * (F.col(f"{v}1") - F.col(f"{v}0"))).alias(v) for v in values])
