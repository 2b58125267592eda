"""Keys that cut finely enough need no leaves, and a side of a few rows goes to all tasks: no row is copied or sent about."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kerbline.operators import packed_tree, polygons, spatial


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_are_joined_without_leaves(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.uniform(0, 3), rng.uniform(0, 1), rng.uniform(-3, 3)) for k in range(900) for i in range(7)]
    frame = spark.createDataFrame(rows, "k int, i int, x double, y double, heading double")
    cols = lambda p: [f"{p}{a}{n}" for n in range(4) for a in "xy"]
    left = spatial.with_box(frame, "a", 4.5, 2.0).select("k", "i", *cols("a"))
    right = spatial.with_box(frame, "b", 1.0, 0.5).select("k", F.col("i").alias("j"), *cols("b"))
    found = spatial.box_join(left, right, ["k"])
    assert "Generate" not in plan_of(found) and "ArrowEvalPython" not in plan_of(found)
    by_leaves = spatial.box_join(left, right, ["k"], 3)
    assert "ArrowEvalPython" in plan_of(by_leaves)
    pairs = lambda df: sorted(map(tuple, df.select("k", "i", "j").collect()))
    assert pairs(found) == pairs(by_leaves) and len(pairs(found)) > 900


def test_loops_take_one_exchange_of_routes(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = [(r, i, True, [(x + (i % 3) * 3, y) for x, y in square]) for r in range(3000) for i in range(4)]
    blocks = spark.createDataFrame(rows, "route int, idx int, connector boolean, ring array<struct<x: double, y: double>>")
    found = polygons.cut_loops(blocks, "route", "idx", "connector")
    assert "_leaf" not in plan_of(found) and found.groupBy("idx").count().count() == 3 and found.count() == 9000


def test_a_corridor_of_few_points_moves_no_object(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 9.0, 0.0), (1, 2, 9.0, 6.0)], "k int, n int, x double, y double")
    rng = random.Random(2)
    many = spark.createDataFrame([(1, i, rng.uniform(-3, 12), rng.uniform(-3, 9), 0.3) for i in range(packed_tree.LEAF_ROWS + 10)], "k int, i int, x double, y double, heading double")
    objects = spatial.with_box(many, "b", 1.0, 0.5).select("k", "i", *[f"b{a}{n}" for n in range(4) for a in "xy"])
    found = spatial.corridor_join(line, objects, ["k"], "n", 0.3)
    assert "BroadcastHashJoin" in plan_of(found) and "ArrowEvalPython" not in plan_of(found)
    few = objects.where("i < 2000")
    assert sorted(r.i for r in found.where("i < 2000").collect()) == sorted(r.i for r in spatial.corridor_join(line, few, ["k"], "n", 0.3).collect())


def test_leaves_are_not_cut_below_boxes():
    import numpy as np

    x = np.random.default_rng(0).uniform(0, 67, 5000)
    tree = packed_tree.Tree(x, x * 0, 5, (3.0, 3.0))
    low, high = (x - 1.5, x * 0 - 1.5), (x + 1.5, x * 0 + 1.5)
    row, _ = tree.meeting(low, high)
    assert len(tree.leaves) < 67 and len(row) < 4 * len(x)
