"""Frame logs, metric caches, submissions and reports as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.functions.text import path_part

FRAME_DDL = """log_name string, scene_token string, token string, frame_idx int, timestamp long, map_location string, roadblock_ids array<string>,
traffic_lights array<struct<lane_connector_id:string,is_red:boolean>>, ego2global_translation array<double>, ego2global_rotation array<double>,
ego_dynamic_state array<double>, driving_command array<int>, lidar_path string, cams map<string,struct<data_path:string>>,
anns struct<gt_boxes:array<array<double>>,gt_names:array<string>,gt_velocity_3d:array<array<double>>,instance_tokens:array<string>,track_tokens:array<string>>"""


def write_log(frames: DataFrame, path: str) -> None:
    """Frames partitioned by log, so that a filter on log names prunes whole folders."""
    frames.write.mode("overwrite").partitionBy("log_name").parquet(path)


def read_log(spark: SparkSession, path: str, logs: list[str] | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found.where(F.col("log_name").isin(logs)) if logs is not None else found


def read_raw_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines export of raw frames, under the fixed schema."""
    return spark.read.schema(FRAME_DDL).json(path)


def write_cache(rows: DataFrame, path: str, by: str = "log_name") -> None:
    rows.write.mode("append").partitionBy(by).option("compression", "zstd").parquet(path)


def cached_token(spark: SparkSession, path: str, token: str) -> DataFrame:
    """Point read: the filter reaches the row groups."""
    return spark.read.parquet(path).where(F.col("token") == token)


def cache_index(spark: SparkSession, path: str) -> DataFrame:
    """(token, path) from a CSV of cache file paths: the token is the folder that holds the file."""
    rows = spark.read.option("header", True).schema("path string").csv(path)
    return rows.select(path_part(F.col("path"), -2).alias("token"), "path")


def write_index(rows: DataFrame, path: str) -> None:
    rows.select("path").write.mode("overwrite").option("header", True).csv(path)


def export_cache(rows: DataFrame, path: str, files: int = 1) -> None:
    """All cached tokens as a few files, by hash of the token; one file is meant for tables that fit one task."""
    rows.repartition(files, "token").write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_submission(predictions: DataFrame, path: str, team: str) -> None:
    """predictions: (seed, token, poses)."""
    predictions.withColumn("team", F.lit(team)).write.mode("overwrite").parquet(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """A submission of exactly one seed; an error otherwise."""
    rows = spark.read.parquet(path)
    seeds = [r[0] for r in rows.select("seed").distinct().limit(2).collect()]
    if len(seeds) != 1:
        raise ValueError(f"{path}: exactly one seed is expected")
    return rows


def merge_submissions(inputs: list[DataFrame], expected: DataFrame) -> DataFrame:
    """All inputs together, if each has exactly the expected tokens."""
    for k, rows in enumerate(inputs):
        for a, b, what in ((expected, rows, "lacks"), (rows, expected, "adds")):
            if not a.select("token").join(b.select("token"), "token", "left_anti").isEmpty():
                raise ValueError(f"input {k} {what} tokens")
    out = inputs[0]
    for rows in inputs[1:]:
        out = out.unionByName(rows)
    return out


def write_report(reports: DataFrame, path: str) -> None:
    """Simulation reports with their duration."""
    reports.withColumn("duration", F.col("end_time") - F.col("start_time")).write.mode("overwrite").parquet(path)


def as_json(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): every row as one document."""
    return rows.select(key, F.to_json(F.struct("*")).alias("json"))


def annotations_long(frames: DataFrame) -> DataFrame:
    """One row per annotation; the parallel arrays must have one length."""
    a = "anns."
    arrays = [a + n for n in ("gt_boxes", "gt_names", "gt_velocity_3d", "instance_tokens", "track_tokens")]
    sizes = F.array_distinct(F.array(*[F.size(x) for x in arrays]))
    checked = frames.withColumn("_ok", F.when(F.size(sizes) > 1, F.raise_error(F.lit("annotation arrays differ in length"))).otherwise(True)).where("_ok")
    zipped = F.explode(F.arrays_zip(*arrays)).alias("z")
    return checked.select("log_name", "token", "frame_idx", zipped).select(
        "log_name", "token", "frame_idx", F.col("z.gt_boxes").alias("box"), F.col("z.gt_names").alias("name"), F.col("z.gt_velocity_3d").alias("velocity"), F.col("z.track_tokens").alias("track_token")
    )


def typed_tracks(annotations: DataFrame, kinds: DataFrame, headings: DataFrame) -> DataFrame:
    """Annotations with their object type; agents get their velocity turned into the global frame, all others have none.

    annotations: as annotations_long gives them; kinds: (name, type, is_agent), a small dimension; headings: (token, heading) of the ego vehicle.
    """
    typed = annotations.join(kinds, "name").join(headings, "token")
    vx, vy = F.get("velocity", F.lit(0)), F.get("velocity", F.lit(1))
    gx, gy, _ = geo.to_global(vx, vy, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("heading"))
    agent = lambda c: F.when(F.col("is_agent"), c)
    return typed.select("log_name", "token", "frame_idx", "track_token", "type", "box", agent(gx).alias("vx"), agent(gy).alias("vy"))
