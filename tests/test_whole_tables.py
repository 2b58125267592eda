"""Queries without SQL read every row of their tables: plain versions of them over the whole table."""

from __future__ import annotations

import math
from collections import defaultdict

from kerbline.queries import QUERIES
from kerbline.registry import poses

RINGS = (((0.03, 0.02), (30.03, 0.02), (30.03, 0.33), (15.03, 0.13), (0.03, 0.33)), ((10.03, -0.61), (60.03, -0.61), (60.03, 0.053), (35.03, -0.21), (10.03, 0.053)))
WORDS = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 0.2, 0.4), (1.0, -0.2, -0.4))


def near(px, py, ring, radius):
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        dx, dy = bx - ax, by - ay
        t = min(max(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1)
        if math.hypot(px - ax - t * dx, py - ay - t * dy) <= radius:
            return True
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_map_radius_looks_at_every_frame(spark, sf_dir):
    want = sorted((r.token, k) for r in poses(spark, sf_dir).collect() for k, ring in enumerate(RINGS) if near(r.x, r.heading, ring, 2.0))
    assert sorted((r.token, r.polygon_id) for r in QUERIES["map_radius"](spark, sf_dir).collect()) == want


def corners(x, y, h):
    return [(x + a * 2.25 * math.cos(h) - b * math.sin(h), y + a * 2.25 * math.sin(h) + b * math.cos(h)) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]


def test_tokenise_seq_takes_whole_logs(spark, sf_dir):
    logs = defaultdict(list)
    for r in sorted(poses(spark, sf_dir).collect(), key=lambda r: (r.log, r.idx)):
        logs[r.log].append(r)
    found = {r.log: [int(t) for t in r.tokens.split(" ")] for r in QUERIES["tokenise_seq"](spark, sf_dir).collect()}
    assert {log: len(t) for log, t in found.items()} == {log: len(rows) - 1 for log, rows in logs.items() if len(rows) > 1}
    for log, tokens in found.items():
        x, y, h = 0.0, 0.0, 0.0
        for r, token in zip(logs[log][1:], tokens, strict=True):
            dx, dy = r.x - logs[log][0].x - x, r.y - y
            there = corners(dx * math.cos(h) + dy * math.sin(h), dy * math.cos(h) - dx * math.sin(h), math.atan2(math.sin(-h), math.cos(-h)))
            away = [sum(math.dist(p, q) for p, q in zip(there, corners(*w), strict=True)) for w in WORDS]
            assert away[token] <= min(away) + 1e-9, (log, r.idx)
            wx, wy, wh = WORDS[token]
            x, y, h = x + wx * math.cos(h) - wy * math.sin(h), y + wx * math.sin(h) + wy * math.cos(h), h + wh
