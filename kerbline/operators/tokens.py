"""Action codebook: segments, disk clustering, nearest code words, sequential tokenisation and rollout.

A code word is the four corners (LF, RF, RB, LB) of the vehicle box after a step, as offsets from the pose
before.  A codebook has a fixed size (a few thousand words at most), is checked for it, and travels as one
array value beside the rows, so matching stays in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.functions.symbolic import let
from kerbline.operators.sequence import along
from kerbline.session import cut

#: Code words that a codebook may have.
MOST_WORDS = 8192
LENGTH, WIDTH = 4.5, 2.0


def segments(poses: DataFrame, by: str, order: str) -> DataFrame:
    """Each pose as seen from the pose before; the first row is zero."""
    w = along(by, order)
    names = ("x", "y", "heading")
    own = poses.select(by, order, *names, *[F.coalesce(F.lag(n).over(w), F.col(n)).alias(f"_{n}") for n in names])
    local = geo.to_local(*[F.col(n) for n in names], *[F.col(f"_{n}") for n in names])
    return own.select(by, order, *[c.alias(f"d{n[0]}") for c, n in zip(local, names, strict=True)])


def corners_array(x: Column, y: Column, h: Column, length: float = LENGTH, width: float = WIDTH) -> Column:
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in geo.box_corners(x, y, h, length, width)])


def corner_distance(a: Column, b: Column) -> Column:
    """Sum over the corners of the distance between two boxes; products and a root, which round alike everywhere, so a distance at a tolerance falls on one side."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))), F.lit(0.0), lambda s, d: s + d)


def as_one_row(codebook: DataFrame) -> DataFrame:
    """The codebook (token_id, corners) as one row: words, an array in the order of ids."""
    found = codebook.agg(F.sort_array(F.collect_list(F.struct("token_id", "corners"))).alias("words"))
    return found.withColumn("words", F.when(F.size("words") <= MOST_WORDS, F.col("words")).otherwise(F.raise_error(F.lit(f"more than {MOST_WORDS} code words"))))


def nearest_word(corners: Column, words: Column) -> Column:
    """(distance, token_id) of the nearest word, the smallest id on ties."""
    return F.array_min(F.transform(words, lambda w: F.struct(corner_distance(corners, w.corners).alias("distance"), w.token_id.alias("token_id"))))


def nearest_codes(rows: DataFrame, codebook: DataFrame, corners: str = "corners") -> DataFrame:
    joined = rows.join(F.broadcast(as_one_row(codebook)))  # one row of checked size
    return joined.withColumn("_n", nearest_word(F.col(corners), F.col("words"))).select(*rows.columns, F.col("_n.token_id").alias("token_id"), F.col("_n.distance").alias("distance"))


def _mapped(f: Callable, *columns: np.ndarray) -> np.ndarray:
    return np.fromiter(map(f, *[c.tolist() for c in columns]), float, len(columns[0]))


def _segments_in_c(x: np.ndarray, y: np.ndarray, h: np.ndarray, ox: np.ndarray, oy: np.ndarray, oh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dx, dy, turn = x - ox, y - oy, h - oh
    cos, sin = _mapped(math.cos, oh), _mapped(math.sin, oh)
    return dx * cos + dy * sin, dy * cos - dx * sin, _mapped(math.atan2, _mapped(math.sin, turn), _mapped(math.cos, turn))


def exact_segments(poses: DataFrame, by: str, order: str) -> DataFrame:
    """As segments, with the C library's sine, cosine and arc tangent, as SQL engines outside the JVM have them: the JVM's differ in
    the last bit at times, which decides where a distance is at a tolerance.  Angles are finite."""
    w = along(by, order)
    names = ("x", "y", "heading")
    own = [F.col(n).cast("double") for n in names]

    @F.pandas_udf("dx double, dy double, dh double")
    def local(x: pd.Series, y: pd.Series, h: pd.Series, ox: pd.Series, oy: pd.Series, oh: pd.Series) -> pd.DataFrame:
        found = _segments_in_c(*[c.to_numpy(float) for c in (x, y, h, ox, oy, oh)])
        return pd.DataFrame(dict(zip(("dx", "dy", "dh"), found, strict=True)))

    before = poses.select(by, order, *own, *[F.coalesce(F.lag(n).over(w), c).alias(f"_{n}") for n, c in zip(names, own, strict=True)])
    return before.select(by, order, local(*names, *[f"_{n}" for n in names]).alias("_s")).select(by, order, "_s.*")


def _corners_in_c(x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of boxes, a row for each corner, by the C library."""
    cos, sin = _mapped(math.cos, h), _mapped(math.sin, h)
    signs = ((1, 1), (1, -1), (-1, -1), (-1, 1))
    return (
        np.array([x + a * (LENGTH / 2) * cos - b * (WIDTH / 2) * sin for a, b in signs]),
        np.array([y + a * (LENGTH / 2) * sin + b * (WIDTH / 2) * cos for a, b in signs]),
    )


def _near(cx: np.ndarray, cy: np.ndarray, sx: np.ndarray, sy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which boxes (corner by box) are near to a seed (its four corners).  power(v, 2) of the C library is not always v * v, so
    distances at the tolerance are worked out again with it."""
    dx, dy = cx - sx[:, None], cy - sy[:, None]
    mean = lambda d: (d[0] + d[1] + d[2] + d[3]) / 4
    d = mean(np.sqrt(dx * dx + dy * dy))
    close = np.flatnonzero(np.abs(d - tolerance) <= 1e-9 * max(1.0, tolerance))
    if len(close):
        square = lambda v: np.array([_mapped(lambda q: math.pow(q, 2.0), c) for c in v[:, close]])
        d[close] = mean(np.sqrt(square(dx) + square(dy)))
    return d <= tolerance


def _greedy_seeds(cx: np.ndarray, cy: np.ndarray, tolerance: float, most: int) -> list[int]:
    """Places of the boxes that no earlier seed is near to, in order; nearness as in the tasks, bit by bit."""
    free, seeds = np.ones(cx.shape[1], dtype=bool), []
    while len(seeds) < most and free.any():
        at = int(free.argmax())
        free &= ~_near(cx, cy, cx[:, at], cy[:, at], tolerance)
        free[at] = False
        seeds.append(at)
    return seeds


def _first_near(x: np.ndarray, y: np.ndarray, h: np.ndarray, seeds: list[tuple[int, np.ndarray, np.ndarray]], by_cell: dict[tuple[int, int], list[int]], tolerance: float) -> np.ndarray:
    """Number of the first seed that each box is near to, -1 if there is none; only the seeds of its own grid cell are looked at."""
    out = np.full(len(x), -1)
    cx, cy = _corners_in_c(x, y, h)
    cells, which = np.unique(np.floor(np.array([x, y]) / tolerance), axis=1, return_inverse=True)
    which = which.ravel()
    by = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[by], np.arange(cells.shape[1] + 1))
    for c, cell in enumerate(cells.T.tolist()):
        rows = by[ends[c] : ends[c + 1]]
        for s in by_cell.get((int(cell[0]), int(cell[1])), ()):
            if not len(rows):
                break
            k, sx, sy = seeds[s]
            hit = _near(cx[:, rows], cy[:, rows], sx, sy, tolerance)
            out[rows[hit]] = k
            rows = rows[~hit]
    return out


def disk_clusters(points: DataFrame, n: int, tolerance: float, id_col: str = "segment_id", chunk: int = 4096) -> DataFrame:
    """(token_id, x, y, heading, members): take the point with the smallest id that is left, average all within
    `tolerance` (mean corner distance) of it, take them away; at most n times, fewer if no point is left.

    A round takes the next `chunk` points in the order of ids; what they alone decide are all the seeds among them, so
    a round is one pass over the points that are left, whatever it finds.  `chunk` bounds what the driver holds and
    changes no result.  A point looks only at seeds of its grid cell: centres are no farther apart than corners are
    on average.  Points with a null or non-finite coordinate take no part.
    """
    if not 0 < n <= MOST_WORDS or tolerance <= 0:
        raise ValueError(f"from 1 to {MOST_WORDS} words and a positive tolerance")
    spark, names = points.sparkSession, ("x", "y", "heading")
    finite = [F.abs(F.col(c)) < float("inf") for c in names]
    left = cut(points.select(id_col, *[F.col(c).cast("double").alias(c) for c in names]).where(finite[0] & finite[1] & finite[2]))
    found, rows = 0, []
    while found < n:
        first = left.orderBy(id_col, *names).limit(chunk).select(*names).collect()
        if not first:
            break
        taken = cut(left.withColumn("k", _nearest_seed(spark, np.array(first, dtype=float).T, found, tolerance, n - found)(*names)))
        rows += taken.where("k >= 0").groupBy("k").agg(*[F.avg(c) for c in names], F.count("*")).collect()
        found = 1 + max(r.k for r in rows)  # every seed is near to itself
        left = taken.where("k < 0").drop("k")
    return spark.createDataFrame(sorted(map(tuple, rows)), "token_id int, x double, y double, heading double, members long")


def _nearest_seed(spark: SparkSession, first: np.ndarray, found: int, tolerance: float, most: int) -> Callable:
    """A UDF over (x, y, heading): the number of the first near seed of those among the boxes `first`, counted from `found`."""
    cx, cy = _corners_in_c(*first)
    places = _greedy_seeds(cx, cy, tolerance, most)
    seeds = [(found + k, cx[:, at], cy[:, at]) for k, at in enumerate(places)]
    by_cell: dict[tuple[int, int], list[int]] = {}
    for s, at in enumerate(places):  # nine cells a seed, and seeds are at most MOST_WORDS
        i, j = (math.floor(first[c, at] / tolerance) for c in (0, 1))
        for cell in [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            by_cell.setdefault(cell, []).append(s)
    shared = spark.sparkContext.broadcast((seeds, by_cell))

    @F.pandas_udf("int")
    def nearest(x: pd.Series, y: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_first_near(*[c.to_numpy(float) for c in (x, y, h)], *shared.value, tolerance))

    return nearest


def _word_pose(state: Column, corners: Column) -> Column:
    """Pose after a word: the middle of its corners, and the direction from left back to left front."""
    placed = F.transform(
        corners,
        lambda p: F.struct(
            (state.x + p.x * F.cos(state.heading) - p.y * F.sin(state.heading)).alias("x"), (state.y + p.x * F.sin(state.heading) + p.y * F.cos(state.heading)).alias("y")
        ),
    )

    def pose(placed: Column) -> Column:
        mean = lambda get: F.aggregate(F.transform(placed, get), F.lit(0.0), lambda a, b: a + b) / 4
        lf, lb = F.get(placed, F.lit(0)), F.get(placed, F.lit(3))
        return F.struct(mean(lambda p: p.x).alias("x"), mean(lambda p: p.y).alias("y"), F.atan2(lf.y - lb.y, lf.x - lb.x).alias("heading"))

    return let(placed, pose)


def _moved(state: Column, token: Column, word: Column) -> Column:
    """The state of a fold after one more token."""
    grown = lambda pose: F.struct(pose.alias("pose"), F.concat(state.tokens, F.array(token)).alias("tokens"), F.concat(state.poses, F.array(pose)).alias("poses"))
    return let(_word_pose(state.pose, word), grown)


_ZERO = "named_struct('pose', named_struct('x', 0D, 'y', 0D, 'heading', 0D), 'tokens', cast(array() AS array<int>), 'poses', cast(array() AS array<struct<x:double,y:double,heading:double>>))"


def tokenise(trajectories: DataFrame, codebook: DataFrame, key: str, poses: str = "poses") -> DataFrame:
    """Tokens of each trajectory (array of x, y, heading from the origin), one after the other: every step is
    matched from the quantised pose of the step before."""
    joined = trajectories.select(key, poses).join(F.broadcast(as_one_row(codebook)))

    def step(state: Column, target: Column) -> Column:
        at = state.pose
        local = corners_array(*geo.to_local(target.x, target.y, target.heading, at.x, at.y, at.heading))
        word = lambda token: F.filter(F.col("words"), lambda w: w.token_id == token)[0].corners
        return let(local, lambda own: let(nearest_word(own, F.col("words")).token_id, lambda token: _moved(state, token, word(token))))

    done = F.aggregate(poses, F.expr(_ZERO), step)
    return joined.select(key, done.alias("d")).select(key, F.col("d.tokens").alias("tokens"), F.col("d.poses").alias("quantised"))


def rollout(sequences: DataFrame, codebook: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Poses that a token sequence leads through from the origin; unknown tokens are the word 0."""
    joined = sequences.select(key, tokens).join(F.broadcast(as_one_row(codebook)))

    def step(state: Column, token: Column) -> Column:
        word = F.coalesce(F.get(F.filter(F.col("words"), lambda w: w.token_id == token), F.lit(0)), F.col("words")[0]).corners
        return _moved(state, token, word)

    return joined.select(key, F.aggregate(tokens, F.expr(_ZERO), step).poses.alias("poses"))


def decode_ids(ids: Column, start: int, n: int) -> Column:
    """Model ids to n action tokens: ids under `start` are action 0; padded with 0 or cut."""
    shifted = F.transform(ids, lambda i: F.when(i < start, 0).otherwise(i - start).cast("int"))
    return F.slice(F.concat(shifted, F.array_repeat(F.lit(0), n)), 1, n)
