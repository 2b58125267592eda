"""Planar geometry as column expressions; points are (x, y) pairs of columns, polygons arrays of structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def normalize_angle(a: Column) -> Column:
    """To (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def wrap_angle(a: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(TWO_PI)) - math.pi


def to_local(x: Column, y: Column, h: Column, ox: Column, oy: Column, oh: Column, wrap: bool = True) -> tuple[Column, Column, Column]:
    """A pose as seen from an origin pose."""
    dx, dy = x - ox, y - oy
    turn = h - oh
    return dx * F.cos(oh) + dy * F.sin(oh), dy * F.cos(oh) - dx * F.sin(oh), normalize_angle(turn) if wrap else turn


def to_global(x: Column, y: Column, h: Column, ox: Column, oy: Column, oh: Column) -> tuple[Column, Column, Column]:
    return ox + x * F.cos(oh) - y * F.sin(oh), oy + x * F.sin(oh) + y * F.cos(oh), h + oh


def box_corners(x: Column, y: Column, h: Column, length: float | Column, width: float | Column) -> list[tuple[Column, Column]]:
    """Left front, right front, right back, left back."""
    half_l, half_w = (F.lit(v) / 2 if not isinstance(v, Column) else v / 2 for v in (length, width))
    return [(x + a * half_l * F.cos(h) - b * half_w * F.sin(h), y + a * half_l * F.sin(h) + b * half_w * F.cos(h)) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]


def ego_corners(x: Column, y: Column, h: Column, length: float, width: float, rear_to_center: float) -> list[tuple[Column, Column]]:
    """Corners of a vehicle whose pose is that of its rear axle, and its center."""
    cx, cy = x + rear_to_center * F.cos(h), y + rear_to_center * F.sin(h)
    return [*box_corners(cx, cy, h, length, width), (cx, cy)]


def parallel_offset(x: Column, y: Column, h: Column, offset: float) -> tuple[Column, Column]:
    """The point moved to the left by offset."""
    return x - offset * F.sin(h), y + offset * F.cos(h)


def quaternion_yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def quaternion_roll_pitch(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    return F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0)))


def align_two_points(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The rotation that takes direction a to direction b: two points leave no other freedom."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def project_pinhole(x: Column, y: Column, z: Column, f: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Image place of a point in camera coordinates; null behind the camera."""
    return F.when(z > 0, f * F.try_divide(x, z) + cx), F.when(z > 0, f * F.try_divide(y, z) + cy)


def in_view(u: Column, v: Column, z: Column, width: int, height: int, eps: float = 1e-3) -> Column:
    return F.coalesce((z > eps) & (u > 0) & (u < width - 1) & (v > 0) & (v < height - 1), F.lit(False))


def boxes_intersect(a: list[tuple[Column, Column]], b: list[tuple[Column, Column]]) -> Column:
    """Two convex quadrilaterals meet or touch: no edge normal of either separates them."""
    hit = F.lit(True)
    for first in (a, b):
        for i in (0, 1):
            nx, ny = first[i + 1][1] - first[i][1], first[i][0] - first[i + 1][0]
            pa = [x * nx + y * ny for x, y in a]
            pb = [x * nx + y * ny for x, y in b]
            hit = hit & (F.least(*pa) <= F.greatest(*pb)) & (F.least(*pb) <= F.greatest(*pa))
    return hit


def point_in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting on an array of (x, y) structs, open or closed; the border is outside of what counts on two sides."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, n)).alias("b")))
    crossing = lambda e: ((e.a.y > py) != (e.b.y > py)) & (px < (e.b.x - e.a.x) * F.try_divide(py - e.a.y, e.b.y - e.a.y) + e.a.x)
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != F.coalesce(crossing(e), F.lit(False)))


def ring_to_local(ring: Column, ox: Column, oy: Column, oh: Column) -> Column:
    return F.transform(
        ring, lambda p: F.struct(((p.x - ox) * F.cos(oh) + (p.y - oy) * F.sin(oh)).alias("x"), ((p.y - oy) * F.cos(oh) - (p.x - ox) * F.sin(oh)).alias("y"))
    )


def segment_projection(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """(share of the segment at the nearest point, distance to it)."""
    dx, dy = bx - ax, by - ay
    t = F.least(F.greatest(F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return t, F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def quaternion_rotate(w: Column, x: Column, y: Column, z: Column, p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point turned by a unit quaternion."""
    px, py, pz = p
    return (
        (1 - 2 * (y * y + z * z)) * px + 2 * (x * y - w * z) * py + 2 * (x * z + w * y) * pz,
        2 * (x * y + w * z) * px + (1 - 2 * (x * x + z * z)) * py + 2 * (y * z - w * x) * pz,
        2 * (x * z - w * y) * px + 2 * (y * z + w * x) * py + (1 - 2 * (x * x + y * y)) * pz,
    )


def rigid(rotation: tuple[Column, Column, Column, Column], shift: tuple[Column, Column, Column], p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """A point in one frame as seen from the frame that holds it; frames chain by nesting."""
    turned = quaternion_rotate(*rotation, p)
    return tuple(a + b for a, b in zip(turned, shift, strict=True))


def rigid_inverse(rotation: tuple[Column, Column, Column, Column], shift: tuple[Column, Column, Column], p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    w, x, y, z = rotation
    return quaternion_rotate(w, -x, -y, -z, tuple(a - b for a, b in zip(p, shift, strict=True)))
