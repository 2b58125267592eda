"""Footprints against occupied cells without a row a cell."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kerbline.operators import evaluation


def test_hits_as_by_cells_and_nothing_spread_out(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, i % 5, rng.uniform(-55, 55), rng.uniform(-55, 55)) for i in range(300)], "token int, step int, x double, y double")
    cells = [(i, i % 5, rng.randrange(-3, 204), rng.randrange(-3, 204)) for i in range(300) for _ in range(300)]
    occupied = spark.createDataFrame(cells, "token int, step int, row long, col long")
    on = ["token", "step"]
    found = evaluation.hits(rows, occupied, on, F.col("x"), F.col("y"))
    want = evaluation.rasterised(rows, F.col("x"), F.col("y")).join(occupied, [*on, "row", "col"], "left_semi").select(*on).distinct()
    assert 0 < want.count() < 300 and sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
