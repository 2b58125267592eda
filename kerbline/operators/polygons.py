"""Areas that simple polygons share, convex or not, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.packed_tree import packed_join

#: Shares of an area that count as overlap, in square metres.
LOOP_AREA = 1.0


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a.x - o.x) * (b.y - o.y) - (a.y - o.y) * (b.x - o.x)


def fan(ring: Column) -> Column:
    """Triangles from the first corner to each side, turned counter-clockwise, with the sign of their turn: with signs they add up to the polygon, convex or not."""

    def triangle(i: Column) -> Column:
        a, b, c = F.get(ring, F.lit(0)), F.get(ring, i), F.get(ring, i + 1)
        turn = _cross(a, b, c)
        return F.struct(a.alias("a"), F.when(turn < 0, c).otherwise(b).alias("b"), F.when(turn < 0, b).otherwise(c).alias("c"), F.signum(turn).alias("sign"))

    some = F.transform(F.sequence(F.lit(1), F.size(ring) - 2), triangle)
    return F.when(F.size(ring) >= 3, F.filter(some, lambda t: t.sign != 0)).otherwise(F.array().cast("array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>, c: struct<x: double, y: double>, sign: double>>"))


def _clip(rows: DataFrame, corners: str, a: Column, b: Column) -> DataFrame:
    """rows with what is left of the convex polygon `corners` left of the line from a to b."""
    n = F.size(corners)
    # how far left each corner lies, worked out once for it
    rows = rows.withColumn("_side", F.transform(corners, lambda p: _cross(a, b, p)))

    def kept(p: Column, i: Column) -> Column:
        s, t = F.get("_side", i), F.get("_side", F.pmod(i + 1, n))
        q, u = F.get(corners, F.pmod(i + 1, n)), F.try_divide(s, s - t)
        met = F.struct((p.x + u * (q.x - p.x)).alias("x"), (p.y + u * (q.y - p.y)).alias("y"))
        return F.array(F.when(s >= 0, p), F.when(s * t < 0, met))

    return rows.withColumn(corners, F.array_compact(F.flatten(F.transform(corners, kept)))).drop("_side")


def ring_area(ring: Column) -> Column:
    """Signed area, positive for a counter-clockwise ring."""
    n = F.size(ring)
    part = lambda i: F.get(ring, i).x * F.get(ring, F.pmod(i + 1, n)).y - F.get(ring, F.pmod(i + 1, n)).x * F.get(ring, i).y
    return F.when(n > 2, F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0.0), lambda s, x: s + x) / 2).otherwise(0.0)


def shared_areas(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, area): what the rings a and b of each pair have in common; rings are arrays of structs of x and y without the closing corner.

    Signed fan triangles of either side are clipped by one another and added up, a row for each two that may meet, so a
    pair of long rings is many small rows.
    """
    box = lambda t: [f([t.getField(c).getField(d) for c in "abc"]) for f in (lambda v: F.least(*v), lambda v: F.greatest(*v)) for d in "xy"]
    one = pairs.select(*key, F.explode(fan(F.col(a))).alias("_p"), F.col(b).alias("_ring"))
    both = one.select(*key, "_p", F.explode(fan(F.col("_ring"))).alias("_q"))
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = box(F.col("_p")), box(F.col("_q"))
    now = both.where((ax0 < bx1) & (bx0 < ax1) & (ay0 < by1) & (by0 < ay1)).withColumn("_left", F.array("_p.a", "_p.b", "_p.c"))
    for s, t in ("ab", "bc", "ca"):
        now = _clip(now, "_left", F.col(f"_q.{s}"), F.col(f"_q.{t}"))
    return now.groupBy(*key).agg(F.abs(F.sum(F.col("_p.sign") * F.col("_q.sign") * F.abs(ring_area(F.col("_left"))))).alias("area"))


def cut_loops(blocks: DataFrame, route: str, idx: str, connector: str, ring: str = "ring", least: float = LOOP_AREA) -> DataFrame:
    """Blocks of routes up to the first connector that shares more than `least` of its area with an earlier connector of its route; that one and all after it go."""
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    own = blocks.where(F.col(connector) & (F.size(ring) >= 3)).select(
        F.col(route).alias("_route"), F.col(idx).alias("_idx"), F.col(ring).alias("_ring"),
        F.array_min(xs).alias("_lx"), F.array_min(ys).alias("_ly"), F.array_max(xs).alias("_hx"), F.array_max(ys).alias("_hy"),
    )
    earlier = own.withColumnsRenamed({c: f"{c}_before" for c in own.columns if c != "_route"})
    sides = lambda suffix: tuple(F.col(f"_{c}{suffix}") for c in ("lx", "ly", "hx", "hy"))
    met = packed_join(own, earlier, ["_route"], sides(""), sides("_before"), F.col("_idx") > F.col("_idx_before"))
    areas = shared_areas(met.select("_route", "_idx", "_idx_before", "_ring", "_ring_before"), ["_route", "_idx", "_idx_before"], "_ring", "_ring_before")
    ends = areas.where(F.col("area") > least).groupBy("_route").agg(F.min("_idx").alias("_end"))
    return blocks.join(ends, F.col(route) == F.col("_route"), "left").where(F.col("_end").isNull() | (F.col(idx) < F.col("_end"))).select(*blocks.columns)
