"""Spatial joins: by the leaves of a packed tree, by a grid cell or a bucket; the exact test follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.operators.packed_tree import packed_join


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def with_cells(rows: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: float) -> DataFrame:
    """A row for each grid cell that a bounding box meets."""
    return rows.withColumn("cx", F.explode(_cells(*x, size))).withColumn("cy", F.explode(_cells(*y, size)))


def _bounds(rows: DataFrame, prefix: str) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    xs, ys = ([F.col(f"{prefix}{a}{i}") for i in range(4)] for a in "xy")
    return (F.least(*xs), F.greatest(*xs)), (F.least(*ys), F.greatest(*ys))


def with_box(rows: DataFrame, prefix: str, length: float, width: float, x: str = "x", y: str = "y", heading: str = "heading") -> DataFrame:
    """Corner columns {prefix}x0 ... {prefix}y3."""
    corners = geo.box_corners(F.col(x), F.col(y), F.col(heading), length, width)
    return rows.select("*", *[c.alias(f"{prefix}{a}{i}") for i, p in enumerate(corners) for a, c in zip("xy", p, strict=True)])


def _axes(rows: DataFrame, p: str) -> DataFrame:
    """Middle, direction and half sizes of a rectangle given by its corners, so that a pair costs a few products."""
    at = lambda a, i: F.col(f"{p}{a}{i}")
    ex, ey = (at("x", 1) - at("x", 0)) / 2, (at("y", 1) - at("y", 0)) / 2
    fx, fy = (at("x", 3) - at("x", 0)) / 2, (at("y", 3) - at("y", 0)) / 2
    e, f = F.hypot(ex, ey), F.hypot(fx, fy)
    # a side without length takes its direction from the other one
    ux = F.when(e > 0, F.try_divide(ex, e)).otherwise(F.coalesce(F.try_divide(fy, f), F.lit(1.0)))
    uy = F.when(e > 0, F.try_divide(ey, e)).otherwise(F.coalesce(F.try_divide(-fx, f), F.lit(0.0)))
    named = {"mx": (at("x", 0) + at("x", 2)) / 2, "my": (at("y", 0) + at("y", 2)) / 2, "ux": ux, "uy": uy, "e": e, "f": f}
    return rows.select("*", *[c.alias(f"_{p}{n}") for n, c in named.items()])


def _meet(eps: float = 1e-9) -> Column:
    """Two rectangles meet or touch: no axis of either parts them."""
    c = F.col
    dx, dy = c("_bmx") - c("_amx"), c("_bmy") - c("_amy")
    along, across = F.abs(c("_aux") * c("_bux") + c("_auy") * c("_buy")), F.abs(c("_aux") * c("_buy") - c("_auy") * c("_bux"))
    parted = (
        (F.abs(dx * c("_aux") + dy * c("_auy")) > c("_ae") + c("_be") * along + c("_bf") * across + eps)
        | (F.abs(dy * c("_aux") - dx * c("_auy")) > c("_af") + c("_be") * across + c("_bf") * along + eps)
        | (F.abs(dx * c("_bux") + dy * c("_buy")) > c("_be") + c("_ae") * along + c("_af") * across + eps)
        | (F.abs(dy * c("_bux") - dx * c("_buy")) > c("_bf") + c("_ae") * across + c("_af") * along + eps)
    )
    return ~parted


def _box(rows: DataFrame, prefix: str) -> tuple[Column, Column, Column, Column]:
    (x0, x1), (y0, y1) = _bounds(rows, prefix)
    return x0, y0, x1, y1


def box_join(left: DataFrame, right: DataFrame, on: list[str], leaf_rows: int | None = None) -> DataFrame:
    """Pairs whose rectangles (corner columns a*, b*) meet or touch, with equal keys `on`: a join on the leaves of a packed tree, then the exact test."""
    met = packed_join(_axes(left, "a"), _axes(right, "b"), on, _box(left, "a"), _box(right, "b"), _meet(), leaf_rows)
    return met.select(*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on])


def time_shifted(rows: DataFrame, offsets: list[int], time: str) -> DataFrame:
    """A copy of each row for each look-ahead; `t` is the time it looks at."""
    return rows.withColumn("ahead", F.explode(F.array(*[F.lit(k).cast("long") for k in offsets]))).withColumn("t", F.col(time) + F.col("ahead"))


def point_in_polygon(points: DataFrame, polygons: DataFrame, x: str = "px", y: str = "py", ring: str = "ring", on: list[str] | None = None) -> DataFrame:
    """Points joined to the polygons that hold them: a join on the leaves of a packed tree, then ray casting."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    at = (F.col(x), F.col(y), F.col(x), F.col(y))
    around = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return packed_join(points, polygons, on or [], at, around, geo.point_in_ring(F.col(x), F.col(y), F.col(ring)))


def nearest_segment(points: DataFrame, path: DataFrame, by: str) -> DataFrame:
    """Arc length at which each point projects on its path (by, s, x, y and the next row's s1, x1, y1); the first segment on ties.

    Distances that are equal to nine decimals are ties: two segments that share the nearest corner differ in the last bits only.
    """
    t, d = geo.segment_projection(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    both = points.join(path, by).select(*points.columns, (F.col("t0") + t * (F.col("t1") - F.col("t0"))).alias("s"), d.alias("d"), "t0")
    return both.groupBy(*points.columns).agg(F.min_by("s", F.struct(F.round("d", 9), "t0")).alias("s"), F.min("d").alias("distance"))


def nearest_within(left: DataFrame, right: DataFrame, on: str, at: str, reach: float, id_col: str) -> DataFrame:
    """For each left row the nearest right row ahead of it by at most `reach`: buckets of width reach, then a minimum."""
    a = left.withColumn("bucket", F.explode(F.array(F.floor(F.col(at) / reach), F.floor(F.col(at) / reach) + 1)))
    b = right.select(on, F.col(at).alias("at_b"), F.col(id_col).alias("found")).withColumn("bucket", F.floor(F.col("at_b") / reach))
    pairs = a.join(b, [on, "bucket"]).where((F.col("at_b") > F.col(at)) & (F.col("at_b") <= F.col(at) + reach))
    return pairs.groupBy(*left.columns).agg(F.min_by("found", F.struct("at_b", "found")).alias("found"), F.min(F.col("at_b") - F.col(at)).alias("gap"))


def histogram_2d(rows: DataFrame, x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float], bins: int, cap: int) -> DataFrame:
    """Counts per cell, clipped at cap and scaled to 1; the last bin holds its right edge."""

    def place(v: Column, low: float, high: float) -> Column:
        return F.when(v == high, bins - 1).otherwise(F.floor((v - low) / ((high - low) / bins))).cast("long")

    inside = (x >= x_range[0]) & (x <= x_range[1]) & (y >= y_range[0]) & (y <= y_range[1])
    cells = rows.where(inside).groupBy(place(x, *x_range).alias("bx"), place(y, *y_range).alias("bin_y")).agg(F.count("*").alias("n"))
    return cells.select("bx", "bin_y", (F.least("n", F.lit(cap)) / float(cap)).alias("share"))


def corridor_join(path: DataFrame, objects: DataFrame, on: list[str], order: str, half_width: float, x: str = "x", y: str = "y") -> DataFrame:
    """Objects (corner columns b*) that meet a path widened by half_width, with round joins and square ends.

    path: on, order, x, y, the points of one line for each `on`.  The widened path is the union of a box for each piece,
    longer by half_width at the line's two ends, and a disc around each inner point, so bends are round; each part is
    tested exactly.  Points that repeat the one before are left out; a line of one point is no path.  An object comes
    once however many parts it meets.
    """
    line = Window.partitionBy(*on).orderBy(order)
    place = F.struct(x, y)
    points = path.select(*on, order, x, y, (~F.coalesce(F.lag(place).over(line) == place, F.lit(False))).alias("_new")).where("_new")
    pieces = points.select(*on, F.col(x).alias("_x0"), F.col(y).alias("_y0"), F.lead(x).over(line).alias("_x1"), F.lead(y).over(line).alias("_y1"), F.lag(x).over(line).isNull().alias("_first"), (F.lead(x, 2).over(line)).isNull().alias("_last"))
    pieces = pieces.where("_x1 IS NOT NULL")
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    before, after = F.when(F.col("_first"), half_width).otherwise(0.0), F.when(F.col("_last"), half_width).otherwise(0.0)
    length = F.hypot(dx, dy)
    shift = (after - before) / 2 / length
    middle = ((F.col("_x0") + F.col("_x1")) / 2 + dx * shift, (F.col("_y0") + F.col("_y1")) / 2 + dy * shift)
    corners = geo.box_corners(*middle, F.atan2(dy, dx), length + before + after, 2 * half_width)
    # a piece and the disc at its start are one row, so that the objects are met once
    boxed = pieces.select(*on, "_first", F.col("_x0").alias("_px"), F.col("_y0").alias("_py"), *[c.alias(f"a{a}{i}") for i, p in enumerate(corners) for a, c in zip("xy", p, strict=True)])
    low_x, low_y, high_x, high_y = _box(boxed, "a")
    reach = F.lit(half_width)
    around = (F.least(low_x, F.col("_px") - reach), F.least(low_y, F.col("_py") - reach), F.greatest(high_x, F.col("_px") + reach), F.greatest(high_y, F.col("_py") + reach))
    u, v = F.col("_px") - F.col("_bmx"), F.col("_py") - F.col("_bmy")
    beyond = lambda along, half: F.greatest(F.abs(along) - half, F.lit(0.0))
    gap = F.hypot(beyond(u * F.col("_bux") + v * F.col("_buy"), F.col("_be")), beyond(v * F.col("_bux") - u * F.col("_buy"), F.col("_bf")))
    in_bend = ~F.col("_first") & (gap <= half_width + 1e-9)
    return packed_join(_axes(boxed, "a"), _axes(objects, "b"), on, around, _box(objects, "b"), _meet() | in_bend).select(*objects.columns).distinct()


def nearest_lane(points: DataFrame, lanes: DataFrame, key: str, near: float, far: float, size: float) -> DataFrame:
    """The lane whose point is nearest: on-route lanes within `near` come first, then any within `far`.

    points: key, px, py; lanes: lane_id, on_route, x, y.  Lane points meet by grid cells of the far distance, so size >= far.
    """
    cell = lambda c: F.floor(F.col(c) / size)
    # of lanes at one place only the first can be the answer
    lanes = lanes.groupBy("on_route", "x", "y").agg(F.min("lane_id").alias("lane_id"))
    around = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asked = points.withColumn("_n", F.explode(around)).withColumn("cx", cell("px") + F.col("_n.i")).withColumn("cy", cell("py") + F.col("_n.j"))
    met = asked.join(lanes.withColumn("cx", cell("x")).withColumn("cy", cell("y")), ["cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).where(F.col("d") <= far)
    first = F.when(F.col("on_route") & (F.col("d") <= near), 0).otherwise(1)
    return met.groupBy(key).agg(F.min_by("lane_id", F.struct(first, "d", "lane_id")).alias("lane_id"), F.min_by("d", F.struct(first, "d", "lane_id")).alias("distance"))


def nearest_lane_by_heading(points: DataFrame, hits: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """The containing lane (hits: key, lane_id, error) with the smallest heading error; where no lane contains the point, the nearest (near: key, lane_id)."""
    inside = hits.groupBy(key).agg(F.min_by("lane_id", F.struct("error", "lane_id")).alias("_in"))
    return points.select(key).join(inside, key, "left").join(near.select(key, F.col("lane_id").alias("_near")), key, "left").select(key, F.coalesce("_in", "_near").alias("lane_id"))


def as_of_index(rows: DataFrame, cached: DataFrame, on: list[str], idx: str, every: int) -> DataFrame:
    """Rows at a fine index joined to what was cached for the coarse one below it."""
    return rows.withColumn("_slot", F.floor(F.col(idx) / every)).join(cached.withColumnRenamed("slot", "_slot"), [*on, "_slot"]).drop("_slot")


def ego_area_flags(hits: DataFrame, states: DataFrame, key: list[str]) -> DataFrame:
    """Flags per state from point-in-polygon hits (key, corner 0-3 or 4 for the center, polygon_id, layer, on_route).

    multi_lane: more than one lane holds a corner and none holds all four; off_road: fewer than four corners lie on
    anything drivable; oncoming: the center is in no lane of the route.
    """
    lane = F.col("layer").isin("LANE", "LANE_CONNECTOR")
    per = hits.where((F.col("corner") < 4) & lane).groupBy(*key, "polygon_id").agg(F.count_distinct("corner").alias("n"))
    lanes = per.groupBy(*key).agg(F.count("*").alias("lanes"), F.max("n").alias("most"))
    covered = hits.where(F.col("corner") < 4).groupBy(*key).agg(F.count_distinct("corner").alias("covered"))
    center = hits.where((F.col("corner") == 4) & lane & F.col("on_route")).select(*key).distinct().withColumn("_own", F.lit(True))
    out = states.join(lanes, key, "left").join(covered, key, "left").join(center, key, "left")
    return out.select(
        *key,
        ((F.coalesce("lanes", F.lit(0)) > 1) & (F.coalesce("most", F.lit(0)) < 4)).alias("multi_lane"),
        (F.coalesce("covered", F.lit(0)) < 4).alias("off_road"),
        F.col("_own").isNull().alias("oncoming"),
    )


def extrapolated(x: Column, y: Column, h: Column, vx: Column, vy: Column, dt: Column) -> tuple[Column, Column, Column]:
    """A pose moved on with its velocity; the heading turns round for an object that moves backwards."""
    back = vx * F.cos(h) + vy * F.sin(h) < 0
    return x + vx * dt, y + vy * dt, F.when(back, geo.normalize_angle(h + geo.TWO_PI / 2)).otherwise(h)


def rasterise(polygons: DataFrame, cell: float, order: str, label: str, ring: str = "ring") -> DataFrame:
    """(row, col, label): cells whose middle a polygon holds; where several do, the one latest in order."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    cells = with_cells(polygons, (F.array_min(xs), F.array_max(xs)), (F.array_min(ys), F.array_max(ys)), cell)
    middle = ((F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)
    held = cells.where(geo.point_in_ring(*middle, F.col(ring)))
    return held.groupBy(F.col("cy").alias("row"), F.col("cx").alias("col")).agg(F.max_by(label, order).alias(label))


def within_radius(points: DataFrame, polygons: DataFrame, key: str, radius: float, ring: str = "ring") -> DataFrame:
    """(key, polygon_id): polygons whose border comes within the radius of a point, or that hold it."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    celled = with_cells(polygons, (F.array_min(xs) - radius, F.array_max(xs) + radius), (F.array_min(ys) - radius, F.array_max(ys) + radius), radius)
    met = points.withColumn("cx", F.floor(F.col("px") / radius)).withColumn("cy", F.floor(F.col("py") / radius)).join(celled, ["cx", "cy"])
    n = F.size(ring)
    border = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: geo.segment_projection(F.col("px"), F.col("py"), F.get(ring, i).x, F.get(ring, i).y, F.get(ring, F.pmod(i + 1, n)).x, F.get(ring, F.pmod(i + 1, n)).y)[1],
    )
    return met.where((F.array_min(border) <= radius) | geo.point_in_ring(F.col("px"), F.col("py"), F.col(ring))).select(key, "polygon_id")
