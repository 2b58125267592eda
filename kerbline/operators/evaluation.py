"""Open-loop evaluation: displacement errors, cumulative forms, footprints on an occupancy grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.sequence import along

#: Fixed values of the grid: cells, their size in metres, footprint of the vehicle and its shift.
CELLS, CELL, FOOTPRINT, SHIFT = 200, 0.5, (1.85, 4.084), 0.5


def usable(predictions: DataFrame, truth: DataFrame, masks: DataFrame, segmented: DataFrame, on: list[str]) -> DataFrame:
    """Only samples that have a prediction, a truth, a mask that is not zero and a segmentation."""
    kept = masks.where("m > 0").select(*on, "m")
    return predictions.join(truth, on).join(kept, on).join(segmented.select("token").distinct(), "token", "left_semi")


def l2(px: Column, py: Column, gx: Column, gy: Column, mask: Column) -> Column:
    return F.sqrt(((px - gx) * (px - gx) + (py - gy) * (py - gy)) * mask)


def error_by_step(rows: DataFrame, error: Column, step: str = "step") -> DataFrame:
    """Sum and count per future step: partial sums, then one merge."""
    return rows.groupBy(step).agg(F.sum(error).alias("total"), F.count("*").alias("n")).withColumn("mean", F.try_divide("total", "n"))


def cumulative_mean(by_step: DataFrame, value: str, by: list[str], step: str = "step") -> DataFrame:
    """Mean over the steps so far, beside the step's own value."""
    return by_step.withColumn("so_far", F.avg(value).over(along(by, step).rowsBetween(Window.unboundedPreceding, 0)))


def footprint_cells() -> list[tuple[int, int]]:
    """Cells, relative to the vehicle's own, that its axis-parallel box covers."""
    half_w, half_l = FOOTPRINT[0] / 2, FOOTPRINT[1] / 2
    rows = range(math.floor((-half_l + SHIFT) / CELL), math.ceil((half_l + SHIFT) / CELL))
    cols = range(math.floor(-half_w / CELL), math.ceil(half_w / CELL))
    return [(r, c) for r in rows for c in cols]


def rasterised(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """A row for each grid cell that the footprint covers; cells off the grid go."""
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in footprint_cells()])
    out = rows.select("*", F.explode(cells).alias("_cell"))
    row = (F.floor(y / CELL) + CELLS // 2 + F.col("_cell.r")).cast("long")
    col = (F.floor(x / CELL) + CELLS // 2 + F.col("_cell.c")).cast("long")
    return out.select(*rows.columns, row.alias("row"), col.alias("col")).where(f"row BETWEEN 0 AND {CELLS - 1} AND col BETWEEN 0 AND {CELLS - 1}")


def hits(rows: DataFrame, occupied: DataFrame, on: list[str], x: Column, y: Column) -> DataFrame:
    """Rows whose footprint meets an occupied cell of the grid: the footprint is a block of cells, so the cells of a key are held against its borders and it is never spread out."""
    cells = footprint_cells()
    row, col = F.floor(y / CELL).cast("long") + CELLS // 2, F.floor(x / CELL).cast("long") + CELLS // 2
    own = rows.select(*on, row.alias("_row"), col.alias("_col"))
    held = occupied.where(f"row BETWEEN 0 AND {CELLS - 1} AND col BETWEEN 0 AND {CELLS - 1}").select(*[F.col(c).alias(f"_on_{c}") for c in on], "row", "col")
    same = [F.col(c) == F.col(f"_on_{c}") for c in on]
    inside = [(F.col(c) - F.col(f"_{c}")).between(min(k), max(k)) for c, k in zip(("row", "col"), zip(*cells, strict=True), strict=True)]
    return own.join(held, [*same, *inside], "left_semi").select(*on).distinct()


def collisions_where_truth_is_free(predicted: DataFrame, truth_hits: DataFrame, predicted_hits: DataFrame, on: list[str]) -> DataFrame:
    """Whether each prediction hits something, counted only where the truth does not."""
    free = predicted.select(*on).join(truth_hits, on, "left_anti")
    return free.join(predicted_hits.withColumn("_hit", F.lit(1)), on, "left").select(*on, F.col("_hit").isNotNull().alias("hit"))
