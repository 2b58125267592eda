"""Scene extraction: count windows over the frames of a log, filters, keep-last dedup, splits and token sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import draws
from kerbline.session import cut


def number_frames(frames: DataFrame, log: str = "log", order: Iterable[str] = ("ts", "token"), name: str = "idx") -> DataFrame:
    """Position of each frame in its log, from 0."""
    return frames.withColumn(name, F.row_number().over(Window.partitionBy(log).orderBy(*order)) - 1)


def frame_windows(frames: DataFrame, n: int, step: int | None = None, current: int = 0, log: str = "log", idx: str = "idx", keep: Iterable[str] = ("token",)) -> DataFrame:
    """Windows of n frames that start every `step` frames (n if not given); short ones at the end of a log go.

    Returns log, start, token of the current frame (`current` frames after the start) and an array of each kept column.
    A window of frames is one pass over frames that are sorted by log: no join, one exchange.
    """
    step = step or n
    w = Window.partitionBy(log).orderBy(idx)
    ahead = w.rowsBetween(0, n - 1)
    cols = [F.collect_list(c).over(ahead).alias(f"{c}s") for c in keep]
    return (
        frames.select(log, F.col(idx).alias("start"), F.lead("token", current).over(w).alias("token"), F.count("*").over(ahead).alias("_n"), *cols)
        .where((F.col("_n") == n) & (F.col("start") % step == 0))
        .drop("_n")
    )


def tumbling(frames: DataFrame, n: int, aggregates: list[Column], log: str = "log", idx: str = "idx") -> DataFrame:
    """Aggregates over tumbling windows of exactly n frames: a plain grouping, so map-side partial."""
    chunk = F.floor(F.col(idx) / n)
    return frames.groupBy(log, chunk.alias("chunk")).agg(F.count("*").alias("_n"), *aggregates).where(F.col("_n") == n).drop("_n")


def keep_last(rows: DataFrame, key: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """One row per key: the last in the given order (null orders first)."""
    down = [(F.col(c) if isinstance(c, str) else c).desc_nulls_last() for c in order]
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*down))).where("_rn = 1").drop("_rn")


def first_scenes(scenes: DataFrame, most: int, order: Iterable[str]) -> DataFrame:
    """The first scenes in a stated order: a top-n, not a sort of everything."""
    return scenes.orderBy(*order).limit(most)


def with_tokens(scenes: DataFrame, tokens: DataFrame, on: str = "token") -> DataFrame:
    return scenes.join(tokens.select(on), on, "left_semi")


def without_tokens(scenes: DataFrame, tokens: DataFrame, on: str = "token") -> DataFrame:
    """Resume and cache-hit filter: what has not been made yet."""
    return scenes.join(tokens.select(on), on, "left_anti")


def set_difference_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """How many keys are only left, only right, in both; equal if the first two are zero."""
    a = left.select(on).distinct().withColumn("l", F.lit(1))
    b = right.select(on).distinct().withColumn("r", F.lit(1))
    both = a.join(b, on, "full")
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("l").isNull()).alias("unused"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared")
    ).withColumn("equal", (F.col("missing") == 0) & (F.col("unused") == 0))


def complete_keys(parts: DataFrame, key: str, part: str, expected: int) -> DataFrame:
    """Keys for which all expected parts exist."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("n_parts")).where(F.col("n_parts") == expected)


def tokens_by_log(scenes: DataFrame, log: str = "log", token: str = "token") -> DataFrame:
    return scenes.groupBy(log).agg(F.sort_array(F.collect_list(token)).alias("tokens"))


def equal_parts(rows: DataFrame, parts: int, order: Iterable[str]) -> DataFrame:
    """Number rows in order and deal them into equal parts, the remainder to the last.

    Numbers come from a range sort and counts per range, so no task sees all rows.
    """
    spark = rows.sparkSession
    order = list(order)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").count().collect()  # one number per range
    before, total = {}, 0
    for r in sorted(counts):
        before[r["_part"]] = total
        total += r["count"]
    if not total:
        return rows.withColumn("rn", F.lit(0).cast("long")).withColumn("part", F.lit(0).cast("long"))
    offsets = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("_part"))
    size = max(total // parts, 1)
    numbered = ranged.withColumn("rn", (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + offsets).cast("long"))
    return numbered.withColumn("part", F.least(F.floor((F.col("rn") - 1) / size), F.lit(parts - 1)).cast("long")).drop("_part")


def array_lengths_agree(rows: DataFrame, arrays: list[str]) -> Column:
    """Annotations are parallel arrays: whether all have one length."""
    first = F.size(arrays[0])
    same = F.lit(True)
    for a in arrays[1:]:
        same = same & (F.size(a) == first)
    return same


def offset_join(frames: DataFrame, offsets: list[int], log: str = "log", idx: str = "idx", value: str = "token") -> DataFrame:
    """Frames joined to the frames a fixed number of places further on; frames that lack one go."""
    out = frames.select(log, idx, value)
    for k in offsets:
        far = frames.select(F.col(log), (F.col(idx) - k).alias(idx), F.col(value).alias(f"{value}_{k}"))
        out = out.join(far, [log, idx])
    return out


def sequence_complete(frames: DataFrame, length: int, stride: int, log: str = "log", idx: str = "idx") -> DataFrame:
    """Frames whose strided history (idx, idx - stride, ...) exists in full."""
    w = Window.partitionBy(log).orderBy(idx).rangeBetween(-(length - 1) * stride, 0)
    wanted = F.sequence(F.col(idx) - (length - 1) * stride, F.col(idx), F.lit(stride).cast("long"))
    return frames.withColumn("_have", F.collect_list(idx).over(w)).where(F.forall(wanted, lambda x: F.array_contains("_have", x))).drop("_have")


def deterministic_shuffle(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """The same order on every reader of one seed and epoch: by a draw for the key."""
    return rows.withColumn("_order", draws.bits([key], seed, epoch)).orderBy("_order", key).drop("_order")


def shuffled_places(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Rows with `place`, their number from 0 in the order of deterministic_shuffle: ranges and one count a range, no task sees all rows."""
    numbered = equal_parts(rows.withColumn("_order", draws.bits([key], seed, epoch)), 1, ["_order", key])
    return numbered.withColumn("place", F.col("rn") - 1).drop("_order", "rn", "part")
