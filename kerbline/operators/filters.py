"""Projections and filters over frames, objects, point clouds and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import draws


def nearby_objects(objects: DataFrame, ego: DataFrame, radius: float, collided: DataFrame, on: str = "token") -> DataFrame:
    """Objects that are not the ego vehicle, lie within the radius and have not collided before."""
    near = objects.join(ego, on).where((F.col("name") != "ego") & (F.hypot(F.col("x") - F.col("ego_x"), F.col("y") - F.col("ego_y")) <= radius))
    return near.join(collided.select(on, "track_token"), [on, "track_token"], "left_anti").drop("ego_x", "ego_y")


def red_lights_on_route(lights: DataFrame, route_lanes: DataFrame, on: str = "token") -> DataFrame:
    """Connectors with a red light that lie on the route, under their area's own track token."""
    red = lights.where("is_red").join(route_lanes.select(on, F.col("lane_id").alias("lane_connector_id")), [on, "lane_connector_id"], "left_semi")
    return red.withColumn("track_token", F.concat(F.lit("red_light_"), F.col("lane_connector_id").cast("string")))


def history_only(scenes: DataFrame, frames: str, history: int, privileged: tuple[str, ...] = ("anns",)) -> DataFrame:
    """The first frames of each scene, without the columns that an agent may not see."""
    return scenes.withColumn(frames, F.slice(frames, 1, history)).drop(*privileged)


def with_sensors(frames: DataFrame, wanted: dict[str, bool | list[int]], idx: str = "idx") -> DataFrame:
    """Sensor columns of the wanted frames: True all, False none, a list only those; a column that is never wanted is not read."""
    out = frames.drop(*[c for c, use in wanted.items() if use is False or use == []])
    for c, use in wanted.items():
        if isinstance(use, list) and use:
            out = out.withColumn(c, F.when(F.col(idx).isin(use), F.col(c)))
    return out


def inside_box(limits: dict[str, tuple[float, float]]) -> Column:
    """Strictly inside on every axis."""
    return reduce(lambda a, b: a & b, [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in limits.items()])


def height_layer(z: Column, split: float, top: float) -> Column:
    """above or below the split, null from the top on."""
    return F.when(z >= top, None).when(z > split, "above").otherwise("below")


def valid_samples(rows: DataFrame, by: str, order: str, future: int, history: int, train: Column) -> DataFrame:
    """Rows with a row before them, `history` rows before (at least) and, in training, `future` rows after."""
    w = Window.partitionBy(by).orderBy(order)
    own = rows.withColumn("_before", F.row_number().over(w) - 1).withColumn("_after", F.count("*").over(Window.partitionBy(by)) - F.row_number().over(w))
    return own.where((F.col("_before") >= max(1, history)) & (~train | (F.col("_after") >= future))).drop("_before", "_after")


def liked(scores: Column, items: Column) -> Column:
    """Items whose score is not negative."""
    return F.transform(F.filter(F.arrays_zip(scores.alias("s"), items.alias("i")), lambda z: z["s"] >= 0), lambda z: z["i"])


def camera_name(dataset: Column, camera: Column) -> Column:
    """Side cameras of one dataset are the front side cameras of the others."""
    return F.when((dataset == "nuplan") & (camera == "left"), "front_left").when((dataset == "nuplan") & (camera == "right"), "front_right").otherwise(camera)


def split_logs(frames: DataFrame, split: DataFrame, wanted: DataFrame | None = None, log: str = "log") -> DataFrame:
    """Frames of the split's logs, and of the filter's logs if there is one."""
    out = frames.join(split.select(log), log, "left_semi")
    return out.join(wanted.select(log), log, "left_semi") if wanted is not None else out


def visible_boxes(corners: DataFrame, box: str, seen: Column) -> DataFrame:
    """Boxes of which any corner is in view."""
    return corners.groupBy(box).agg(F.bool_or(seen).alias("visible")).where("visible").select(box)


def padded_nearest(rows: DataFrame, by: str, distance: str, value: str, k: int) -> DataFrame:
    """(by, values, mask): the k nearest values in order, zeros where there are fewer."""
    w = Window.partitionBy(by).orderBy(distance, value)
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    got = top.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_rn", value))).alias("_v"))
    values = F.transform("_v", lambda x: x[value].cast("double"))
    return got.select(by, F.slice(F.concat(values, F.array_repeat(F.lit(0.0), k)), 1, k).alias("values"), F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (i <= F.size("_v")).cast("int")).alias("mask"))


def sampled(rows: DataFrame, by: str, rank_by: Column, logit: Column, idx: str, k: int, temperature: float, seed: int) -> DataFrame:
    """One of the k first of each group (smallest rank_by, then idx), drawn with weights exp(logit / temperature): the
    largest of logit plus Gumbel noise."""
    w = Window.partitionBy(by).orderBy("_by", idx)
    top = rows.withColumn("_by", rank_by).withColumn("_l", logit).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return top.withColumn("_g", F.col("_l") / temperature + draws.gumbel([by, idx], seed)).groupBy(by).agg(F.max_by(idx, F.struct("_g", idx)).alias(idx))


def sampled_top_k(rows: DataFrame, by: str, distance: str, idx: str, k: int, temperature: float, seed: int) -> DataFrame:
    """One of the k nearest of each group, drawn with weights exp(-distance / temperature)."""
    return sampled(rows, by, F.col(distance), -F.col(distance), idx, k, temperature, seed)


def sampled_token(rows: DataFrame, by: str, logit: str, distance: str, idx: str, k: int, temperature: float, seed: int, scheme: str) -> DataFrame:
    """The next token of each agent.  distance: to the true next place, null where that is unknown.

    topk_prob: of the k likeliest, by likelihood.  topk_prob_sampled_with_dist: of the k likeliest, the nearer the
    likelier (the likelihood counts only where the true place is unknown).  topk_dist_sampled_with_prob: of the k nearest
    (the likeliest where the place is unknown), by likelihood.
    """
    p, d = F.col(logit), F.col(distance)
    near = F.coalesce(-d, p)
    if scheme == "topk_prob":
        return sampled(rows, by, -p, p, idx, k, temperature, seed)
    if scheme == "topk_prob_sampled_with_dist":
        return sampled(rows, by, -p, near, idx, k, temperature, seed)
    if scheme == "topk_dist_sampled_with_prob":
        return sampled(rows, by, -near, p, idx, k, temperature, seed)
    raise ValueError(f"unknown scheme: {scheme}")


def sampled_from_mixture(modes: DataFrame, tokens: DataFrame, by: str, seed: int) -> DataFrame:
    """The token nearest to a place drawn from a Gaussian mixture: (by, token_id).

    modes: by, mode, logit, mx, my, spread; tokens: (token_id, x, y), a small codebook.  The mode is drawn by its logit,
    the place by two normal deviates; both are hashes of by and seed.
    """
    drawn = sampled(modes, by, F.col("mode"), F.col("logit"), "mode", 1 << 30, 1.0, seed)
    dx, dy = draws.normal_pair([by, "mode"], seed, 1)
    at = drawn.join(modes, [by, "mode"]).select(by, (F.col("mx") + F.col("spread") * dx).alias("px"), (F.col("my") + F.col("spread") * dy).alias("py"))
    book = tokens.agg(F.sort_array(F.collect_list(F.struct("token_id", "x", "y"))).alias("words"))
    nearest = F.array_min(F.transform("words", lambda w: F.struct(F.hypot(w.x - F.col("px"), w.y - F.col("py")).alias("d"), w.token_id.alias("token_id"))))
    return at.join(F.broadcast(book)).select(by, nearest.token_id.alias("token_id"))  # one row: a codebook of fixed size


def random_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash: a top-n, and the same rows on every run and in every engine that has md5."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)
