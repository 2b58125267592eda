"""Scores of trajectories: gated weighted means, group normalisation, penalties, bounds, contact folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of progress, time to collision, comfort and driving direction.
WEIGHTS = {"progress": 5.0, "ttc": 5.0, "comfort": 2.0, "direction": 0.0}


def gated_score(gates: list[Column], weighted: list[tuple[Column, float]]) -> Column:
    """Product of the gates times the weighted mean."""
    total = sum(w for _, w in weighted)
    return reduce(lambda a, b: a * b, gates) * (reduce(lambda a, b: a + b, [m * w for m, w in weighted]) / total)


def normalised_progress(rows: DataFrame, raw: str, gate: Column, by: str, threshold: float = 5.0, name: str = "progress") -> DataFrame:
    """Raw progress times its gate over the group's largest, if that exceeds the threshold; else the gate alone decides."""
    gated = F.col(raw) * gate
    top = F.max(gated).over(Window.partitionBy(by))
    return rows.withColumn(name, F.when(top > threshold, gated / top).otherwise(F.when(gate == 0, 0.0).otherwise(1.0)))


def with_average(rows: DataFrame, key: str, metrics: list[str], valid: str = "valid", label: str = "average") -> DataFrame:
    """Rows and one more: the means without nulls, and whether all are valid."""
    total = rows.agg(F.lit(label).alias(key), F.bool_and(valid).alias(valid), *[F.avg(m).alias(m) for m in metrics])
    return rows.select(F.col(key).cast("string").alias(key), valid, *metrics).unionByName(total)


def strict_bounds(value: Column, low: float | None, high: float | None) -> Column:
    """Strictly inside; a bound of 0 or None is no bound."""
    ok = F.lit(True)
    if low:
        ok = ok & (value > low)
    if high:
        ok = ok & (value < high)
    return ok


def counted_faults(contacts: DataFrame, pair: list[str], order: str, fault: str) -> DataFrame:
    """Contacts in order, where one without fault makes its object ignored from then on.

    So a fault counts if it comes before the pair's first contact without fault: one window minimum.
    """
    first_clean = F.min(F.when(~F.col(fault), F.col(order))).over(Window.partitionBy(*pair))
    return contacts.withColumn("counts", F.col(fault) & (first_clean.isNull() | (F.col(order) < first_clean)))


def first_infraction(rows: DataFrame, by: list[str], bad: Column, time: str, dt: float) -> DataFrame:
    """Time of the first bad row of each group; infinity if there is none."""
    return rows.groupBy(*by).agg((F.coalesce(F.min(F.when(bad, F.col(time))).cast("double"), F.lit(float("inf"))) * dt).alias("first_time"))


def group_advantage(rows: DataFrame, reward: str, by: str, eps: float = 1e-4) -> DataFrame:
    w = Window.partitionBy(by)
    return rows.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + eps))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.try_divide(F.sum(value * mask), F.sum(mask))


def best_proposal(rows: DataFrame, by: str, score: str, idx: str) -> DataFrame:
    """Highest score, the first on ties: an aggregation, no sort."""
    return rows.groupBy(by).agg(F.max_by(F.struct(idx, score), F.struct(F.col(score), -F.col(idx))).alias("b")).select(by, f"b.{idx}", f"b.{score}")


def nearest_k(rows: DataFrame, by: list[str], distance: str, tie: str, caps: Column) -> DataFrame:
    """The nearest rows of each group, up to the group's cap."""
    w = Window.partitionBy(*by).orderBy(distance, tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= caps)


def report(rows: DataFrame, keys: list[str], metrics: list[str], valid: str = "valid") -> DataFrame:
    """Counts, successes and means of every group, of every coarser group and of all rows, in one pass: a rollup of keys.

    level: how many keys are summed over, 0 for the finest groups; keys that are summed over are null there, and a null
    key of a row is told from that by the level.  Means are of rows that are valid and have the metric.
    """
    ok = F.coalesce(F.col(valid), F.lit(False))
    depth = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    means = [F.avg(F.when(ok, F.col(m))).alias(m) for m in metrics]
    return rows.rollup(*keys).agg(depth.alias("level"), F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), *means)
