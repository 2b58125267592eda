"""Shared areas of polygons that need not be convex, loop cuts and corridors with bends, against plain versions."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import polygons, spatial

RING = "array<struct<x: double, y: double>>"


def star(rng, n, cx=0.0, cy=0.0):
    """A simple polygon around a middle, seldom convex, of either turn."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in turns for r in [rng.uniform(0.3, 5)]]
    return ring if rng.random() < 0.5 else ring[::-1]


def inside(px, py, ring):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_shared_areas(spark):
    rng = random.Random(4)
    pairs = [(k, star(rng, rng.randint(3, 9)), star(rng, rng.randint(3, 9), rng.uniform(-3, 3), rng.uniform(-3, 3))) for k in range(12)]
    frame = spark.createDataFrame(pairs, f"k int, a {RING}, b {RING}")
    found = {r.k: r.area for r in polygons.shared_areas(frame, ["k"], "a", "b").collect()}
    turned = {r.k: r.area for r in polygons.shared_areas(frame, ["k"], "b", "a").collect()}
    step = 0.02
    for k, a, b in pairs:
        grid = [(-7 + step * (i + 0.5), -7 + step * (j + 0.5)) for i in range(int(14 / step)) for j in range(int(14 / step))] if k < 3 else []
        if grid:
            cells = sum(inside(x, y, a) and inside(x, y, b) for x, y in grid)
            assert found.get(k, 0.0) == pytest.approx(cells * step * step, abs=0.1)
        assert found.get(k, 0.0) == pytest.approx(turned.get(k, 0.0), abs=1e-9)
    own = polygons.shared_areas(frame.select("k", "a", F.reverse("a").alias("b")), ["k"], "a", "b")
    areas = {r.k: abs(r.area) for r in frame.select("k", polygons.ring_area(F.col("a")).alias("area")).collect()}
    assert {r.k: r.area for r in own.collect()} == pytest.approx(areas)


def test_odd_rings_share_nothing(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rings = [(1, square, []), (2, square, [(0.0, 0.0), (1.0, 1.0)]), (3, square, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (4, square, [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0)]), (5, square, None), (6, square, [(1.0, 1.0), (9.0, 1.0), (9.0, 9.0), (1.0, 9.0)])]
    found = {r.k: r.area for r in polygons.shared_areas(spark.createDataFrame(rings, f"k int, a {RING}, b {RING}"), ["k"], "a", "b").collect()}
    assert {k: v for k, v in found.items() if v} == {6: pytest.approx(1.0)}


def test_routes_end_at_the_first_loop(spark):
    # the second connector lies in the notch of the first, the third covers one of its arms
    notched = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 3.0), (3.0, 3.0), (3.0, 9.0), (0.0, 9.0)]
    notch = [(3.5, 3.5), (5.5, 3.5), (5.5, 8.0), (3.5, 8.0)]
    arm = [(6.5, 5.0), (8.5, 5.0), (8.5, 6.0), (6.5, 6.0)]
    small = [(6.5, 5.0), (7.0, 5.0), (7.0, 6.0), (6.5, 6.0)]
    rows = [("r", 0, False, arm), ("r", 1, True, notched), ("r", 2, True, notch), ("r", 3, False, arm), ("r", 4, True, small), ("r", 5, True, arm), ("r", 6, True, notch)]
    rows += [("s", 0, True, notched), ("s", 1, True, notch), ("t", 0, True, arm), ("t", 1, True, None), ("t", 2, True, arm), (None, 0, True, arm)]
    frame = spark.createDataFrame(rows, f"route string, idx int, connector boolean, ring {RING}")
    kept = sorted((str(r.route), r.idx) for r in polygons.cut_loops(frame, "route", "idx", "connector").collect())
    assert kept == [("None", 0), *[("r", i) for i in range(5)], ("s", 0), ("s", 1), ("t", 0), ("t", 1)]
    assert polygons.cut_loops(frame.limit(0), "route", "idx", "connector").collect() == []


def far_from(px, py, box):
    x, y, h, l, w = box
    u, v = (px - x) * math.cos(h) + (py - y) * math.sin(h), (py - y) * math.cos(h) - (px - x) * math.sin(h)
    return math.hypot(max(abs(u) - l / 2, 0), max(abs(v) - w / 2, 0))


def test_corridors_are_round_at_bends_and_square_at_ends(spark):
    rng = random.Random(6)
    line = [(0.0, 0.0), (0.0, 0.0), (6.0, 0.0), (6.0, 5.0), (1.0, 9.0)]
    boxes = [(i, rng.uniform(-3, 10), rng.uniform(-3, 12), rng.uniform(-3, 3), 0.9, 0.5) for i in range(400)]
    # beyond the round bend at (6, 0), in what a square join would cover; and in the corner of the square start
    boxes += [(1000, 6.95, -0.95, 0.0, 0.1, 0.1), (1001, -0.95, -0.95, 0.0, 0.1, 0.1), (1002, 6.6, -0.6, 0.0, 0.1, 0.1), (1003, -1.2, 0.0, 0.0, 0.1, 0.1)]
    frame = spark.createDataFrame([(*b[:4],) for b in boxes], "i int, x double, y double, heading double")
    sizes = spark.createDataFrame([(b[0], b[4], b[5]) for b in boxes], "i int, length double, width double")
    objects = spatial.with_box(frame.join(sizes, "i"), "b", F.col("length"), F.col("width")).select(F.lit(1).alias("k"), "i", *[f"b{a}{n}" for n in range(4) for a in "xy"])
    path = spark.createDataFrame([(1, n, *p) for n, p in enumerate(line)], "k int, n int, x double, y double")
    found = {r.i for r in spatial.corridor_join(path, objects, ["k"], "n", 1.0).collect()}
    assert 1000 not in found and {1001, 1002} <= found and 1003 not in found
    # points of the corridor, close together, must be in found boxes, and found boxes near such points
    spots = []
    for (ax, ay), (bx, by) in zip(line[1:], line[2:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / n, (by - ay) / n
        first, last = (ax, ay) == line[1], (bx, by) == line[-1]
        for k in range(-20, int(n * 20) + 21):
            t = k / 20
            if (t < 0 and not first) or (t > n and not last):
                continue
            spots += [(ax + t * ux - s / 20 * uy, ay + t * uy + s / 20 * ux) for s in range(-20, 21)]
    for b in boxes[:400]:
        near = min(far_from(x, y, b[1:]) for x, y in spots)
        disc = min(far_from(x, y, b[1:]) for x, y in line[2:-1]) - 1.0
        if min(near, disc) < -1e-6 or near == 0 or disc < 0:
            assert b[0] in found
        elif near > 0.08 and disc > 0:
            assert b[0] not in found
    alone = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0)], path.schema)
    assert spatial.corridor_join(alone, objects, ["k"], "n", 1.0).collect() == []
