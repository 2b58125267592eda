"""Places and distances that are equal but for their last bits."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from kerbline.operators import tokens
from kerbline.oracles import ORACLE_SQL
from kerbline.queries import QUERIES


def test_a_corner_that_two_segments_share_belongs_to_the_first(spark, tmp_path):
    import duckdb

    # the point's distances to two segments with a common corner differ in the last bit, and the later one is smaller
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id = 549").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert [tuple(r) for r in QUERIES["project_progress"](spark, str(tmp_path)).collect()] == con.execute(ORACLE_SQL["project_progress"]).fetchall() == [(549, 0.0)]


def test_corner_distances_are_products_and_a_root(spark):
    rng = random.Random(5)
    some = lambda: [(rng.randrange(100) / 10 + 0.1 * rng.random(), rng.randrange(100) / 10) for _ in range(4)]
    pairs = [(some(), some()) for _ in range(500)]
    ring = "array<struct<x: double, y: double>>"
    found = spark.createDataFrame(pairs, f"a {ring}, b {ring}").select("a", "b", tokens.corner_distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in found:
        d = [math.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) for p, q in zip(r.a, r.b, strict=True)]
        assert r.d == d[0] + d[1] + d[2] + d[3]


def test_disk_clusters_at_the_tolerance_square_as_sql_does(spark):
    import duckdb

    # power(v, 2) of the C library is not v * v here, and the mean distance is half a metre but for its last bits
    seed, other = (0.40563439667688683, -1.2788513346877286, -1.9), (0.7643124421266384, -0.9304979800141356, -1.9)
    corner = lambda a, b: (f"(x + {a * 2.25} * cos(h) - {b} * sin(h))", f"(y + {a * 2.25} * sin(h) + {b} * cos(h))")
    signs = ((1, 1), (1, -1), (-1, -1), (-1, 1))
    corners = ", ".join(f"{c} AS {n}{k}" for k, (a, b) in enumerate(signs) for n, c in zip("xy", corner(a, b), strict=True))
    apart = " + ".join(f"sqrt(power(l.x{k} - s.x{k}, 2) + power(l.y{k} - s.y{k}, 2))" for k in range(4))
    sql = f"WITH p(id, x, y, h) AS (VALUES (1, {seed[0]!r}::DOUBLE, {seed[1]!r}::DOUBLE, {seed[2]!r}::DOUBLE), (2, {other[0]!r}::DOUBLE, {other[1]!r}::DOUBLE, {other[2]!r}::DOUBLE)), c AS (SELECT *, {corners} FROM p) SELECT ({apart}) / 4 <= 0.5 FROM c l, c s WHERE l.id = 2 AND s.id = 1"
    near = duckdb.connect().execute(sql).fetchall()[0][0]
    got = tokens.disk_clusters(spark.createDataFrame([(1, *seed), (2, *other)], "segment_id int, x double, y double, heading double"), 5, 0.5).collect()
    assert near is False and [r.members for r in got] == [1, 1]


def test_exact_segments_are_those_of_the_sql_bit_by_bit(spark):
    rows = [("a", i, i + i % 7 / 10, i % 11 / 10 - 0.5, i % 63 / 10 - 3.1) for i in range(3000)]
    found = tokens.exact_segments(spark.createDataFrame(rows, "log string, idx int, x double, y double, heading double"), "log", "idx").orderBy("idx").collect()
    assert tuple(found[0])[2:] == (0.0, 0.0, 0.0)
    for (_, _, ox, oy, oh), (_, _, x, y, h), r in zip(rows[:-1], rows[1:], found[1:], strict=True):
        dx, dy, turn = x - ox, y - oy, h - oh
        assert (r.dx, r.dy, r.dh) == (dx * math.cos(oh) + dy * math.sin(oh), dy * math.cos(oh) - dx * math.sin(oh), math.atan2(math.sin(turn), math.cos(turn)))
