"""Local and global polynomial fits from moments: sums of t^k y over a window, solved in closed form.

Samples stand one step apart, so the sums of t^k alone are known numbers and a fit of any width is three sums a row;
no matrix of weights enters the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _solved(n: Column, m0: Column, m1: Column, m2: Column, order: int) -> tuple[Column, Column, Column]:
    """Coefficients of 1, t and t^2 around the middle of n samples, from the moments of y around it; the order is at most n - 1."""
    s2 = n * (n * n - 1) / 12
    s4 = s2 * (3 * n * n - 7) / 20
    zero = F.lit(0.0)
    slope = F.when((n > 1) & (order >= 1), m1 / s2).otherwise(zero)
    bend = F.when((n > 2) & (order >= 2), F.try_divide(n * m2 - s2 * m0, n * s4 - s2 * s2)).otherwise(zero)
    return (m0 - bend * s2) / n, slope, bend


def _evaluated(fit: tuple[Column, Column, Column], t: Column, derivative: int, dt: float) -> Column:
    a, b, c = fit
    return (a + b * t + c * t * t if derivative == 0 else (b + 2 * c * t) / dt if derivative == 1 else 2 * c / (dt * dt)).cast("double")


def local_fit(rows: DataFrame, by: str, order_by: str, value: str, window: int, order: int = 2, derivative: int = 0, dt: float = 1.0) -> DataFrame:
    """(by, order_by, value, fitted): one derivative of local_fits."""
    return local_fits(rows, by, order_by, value, window, order, {"fitted": derivative}, dt)


def local_fits(rows: DataFrame, by: str, order_by: str, value: str, window: int, order: int, derivatives: dict[str, int], dt: float = 1.0) -> DataFrame:
    """(by, order_by, value, a column for each of derivatives): the fit of each row's window of `window` samples, or its derivatives, at the row.

    The window begins window // 2 samples before the row, so that of an even window lies half a step off; near the ends
    the first and the last whole window serve all rows that lie in them, and a series that is shorter than the window is
    one fit.  order: 0 to 2, and below the number of samples; derivative: 0 to 2.
    """
    if not (0 <= order <= 2 and all(0 <= d <= 2 for d in derivatives.values()) and window >= 1):
        raise ValueError("fits have order 0 to 2, derivatives 0 to 2 and windows of one sample or more")
    along = Window.partitionBy(by).orderBy(order_by)
    whole = Window.partitionBy(by)
    y = F.col(value).cast("double")
    own = rows.select(by, order_by, value, y.alias("_y"), (F.row_number().over(along) - 1).cast("long").alias("_i"), F.count("*").over(whole).alias("_n"))
    own = own.withColumn("_w", F.least("_n", F.lit(window)).cast("double"))
    # moments of the window that begins at each row, around the row
    ahead = along.rowsBetween(0, window - 1)
    i = F.col("_i")
    sums = own.select("*", F.sum("_y").over(ahead).alias("_m0"), F.sum(i * F.col("_y")).over(ahead).alias("_r1"), F.sum(i * i * F.col("_y")).over(ahead).alias("_r2"))
    c = i + (F.col("_w") - 1) / 2
    m0, m1 = F.col("_m0"), F.col("_r1") - c * F.col("_m0")
    m2 = F.col("_r2") - 2 * c * F.col("_r1") + c * c * F.col("_m0")
    fit = F.struct(*[x.alias(n) for n, x in zip("abc", _solved(F.col("_w"), m0, m1, m2, order), strict=True)], i.alias("start"))
    fitted = sums.select(by, order_by, value, "_i", "_n", "_w", fit.alias("_fit"))
    final = F.col("_n") - F.col("_w")
    start = F.least(F.greatest(i - window // 2, F.lit(0)), final)
    edge = whole.orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chosen = (
        F.when(start == i - window // 2, F.lag("_fit", window // 2).over(along))
        .when(start == 0, F.first("_fit").over(edge))
        .otherwise(F.last(F.when(i == final, F.col("_fit")), ignorenulls=True).over(edge))
    )
    placed = fitted.withColumn("_own", chosen)
    t = i - F.col("_own.start") - (F.col("_w") - 1) / 2
    return placed.select(by, order_by, value, *[_evaluated((F.col("_own.a"), F.col("_own.b"), F.col("_own.c")), t, d, dt).alias(name) for name, d in derivatives.items()])


def global_fit(rows: DataFrame, by: str, position: str, value: str, order: int = 2, derivative: int = 0, dt: float = 1.0) -> DataFrame:
    """(by, position, value, fitted) with one fit for each series; position: the sample's number from 0, without gaps.

    The moments are one aggregate with partial sums, so a series that holds a third of all rows is no single task.
    """
    y, p = F.col(value).cast("double"), F.col(position).cast("double")
    sums = rows.groupBy(by).agg(F.count("*").cast("double").alias("_n"), F.sum(y).alias("_m0"), F.sum(p * y).alias("_r1"), F.sum(p * p * y).alias("_r2"))
    c = (F.col("_n") - 1) / 2
    m1 = F.col("_r1") - c * F.col("_m0")
    m2 = F.col("_r2") - 2 * c * F.col("_r1") + c * c * F.col("_m0")
    fits = sums.select(F.col(by).alias("_by"), c.alias("_c"), *[x.alias(f"_{n}") for n, x in zip("abd", _solved(F.col("_n"), F.col("_m0"), m1, m2, order), strict=True)])
    both = rows.join(fits, F.col(by) == F.col("_by"))
    return both.select(by, position, value, _evaluated((F.col("_a"), F.col("_b"), F.col("_d")), p - F.col("_c"), derivative, dt).alias("fitted"))
