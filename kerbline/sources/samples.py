"""Sample documents, nested question-answer files, linked tables and binary files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.operators.scenes import keep_last

CAMERAS = ("front", "front_left", "front_right", "back", "back_left", "back_right", "left", "right")
#: velocity and cot_output are a scalar or an array depending on the dataset, so they are read as text and unified.
SAMPLE_DDL = (
    "token string, dataset_name string, cot_output string, velocity string, acceleration string, instruction string, gt_trajectory array<array<double>>, his_trajectory array<array<double>>, "
    + ", ".join(f"{c}_camera_paths array<string>" for c in CAMERAS)
    + ", preference_scores array<double>, preference_trajectories array<array<array<double>>>"
)


def _numbers(c: Column) -> Column:
    """A JSON number or list of numbers as an array."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<double>")).when(c.isNotNull(), F.array(c.try_cast("double")))


def read_samples(spark: SparkSession, roots: dict[str, str], lines: bool = False) -> DataFrame:
    """Samples from one or more folders of JSON documents, each tagged with its sensor root; no file is an error.

    roots: folder -> sensor root.  lines: a file holds a document a line, as write_samples leaves them, else one in all, in
    the folder or below it, as write_sample_files leaves them.
    """
    out = None
    for folder, root in sorted(roots.items()):
        rows = spark.read.schema(SAMPLE_DDL).option("multiLine", not lines).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(folder).withColumn("sensor_root", F.lit(root))
        out = rows if out is None else out.unionByName(rows)
    if out is None or out.isEmpty():
        raise ValueError("no sample found")
    return unified(out)


def unified(rows: DataFrame) -> DataFrame:
    """velocity and acceleration as arrays, the reasoning as text and as parts; an empty text counts as reasoning, an empty array doesn't."""
    raw = F.trim("cot_output")
    is_array = F.startswith(raw, F.lit("["))
    parts = F.when(is_array, F.from_json("cot_output", "array<string>")).otherwise(F.when(F.col("cot_output").isNotNull(), F.array("cot_output")))
    return (
        rows.withColumn("velocity", _numbers(F.col("velocity")))
        .withColumn("acceleration", _numbers(F.col("acceleration")))
        .withColumn("cot_parts", parts)
        .withColumn("cot_text", F.array_join("cot_parts", "\n"))
        .withColumn("has_cot", F.size("cot_parts") > 0)
        .drop("cot_output")
    )


def write_samples(rows: DataFrame, path: str) -> None:
    """JSON lines; one document per token is a matter of the reader."""
    rows.write.mode("append").json(path)


def write_sample_files(rows: DataFrame, path: str, latest: Iterable[str] = ()) -> None:
    """One document a file, in a folder named by its token.  Of rows with one token the last in the order of `latest` stays, as
    a later file would overwrite; a token that is there already is written anew, all others are left alone.

    Rows go to tasks by token, as many as shuffles have, and a task writes its files one after the other.  Null tokens share the folder of no name.
    """
    last = keep_last(rows, ["token"], [*latest, F.to_json(F.struct(*rows.columns))])
    spark = rows.sparkSession
    # a stated number and a hash that the rows aren't dealt by yet, or the exchange is left out: adaptive execution would join
    # small parts to one task, and a file costs more than its bytes
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = last.withColumn("sample", F.col("token")).repartition(tasks, F.xxhash64("sample"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").json(path)


def explode_qa(rows: DataFrame, frames: str = "key_frames") -> DataFrame:
    """(scene, frame, kind, question, answer) from scene -> key_frames -> QA lists, all maps."""
    by_frame = rows.select("scene", F.explode(frames).alias("frame", "body"))
    by_kind = by_frame.select("scene", "frame", F.explode("body.QA").alias("kind", "pairs"))
    return by_kind.select("scene", "frame", "kind", F.explode("pairs").alias("qa")).select("scene", "frame", "kind", "qa.Q", "qa.A")


#: What the intent numbers of one dataset mean.
INTENTS = {0: "unknown", 1: "go straight", 2: "go left", 3: "go right"}


def intent_text(intent: Column) -> Column:
    """The instruction that an intent number stands for; any other number is unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv]), intent.cast("int")), F.lit(INTENTS[0]))


def with_reference_text(samples: DataFrame, references: DataFrame, name: str = "reference") -> DataFrame:
    """Samples with the text kept for their token, null where there is none.  references: (token, cot_output); a document without text counts as the empty text."""
    kept = references.select("token", F.coalesce("cot_output", F.lit("")).alias(name))
    return samples.join(kept, "token", "left")


def order_linked(rows: DataFrame, by: str, time: str) -> DataFrame:
    """A linked list (prev and next tokens) as an order: time gives the same sequence, so no pointer is chased."""
    w = Window.partitionBy(by).orderBy(time)
    return rows.withColumn("idx", F.row_number().over(w) - 1).withColumn("prev", F.lag("token").over(w)).withColumn("next", F.lead("token").over(w))


def message_items(rows: DataFrame, frames: str = "images") -> DataFrame:
    """One row per image of a video item, in order."""
    return rows.select("token", F.posexplode(frames).alias("position", "image"))


def read_files(spark: SparkSession, path: str, with_content: bool = False, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime and, if asked for, content) of binary files; unread columns are not loaded."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows if with_content else rows.select("path", "length", "modificationTime")


def frame_numbers(files: DataFrame) -> DataFrame:
    """(sequence, camera, number) of image files named .../<sequence>/<camera>/<number>.<ext>."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/(\d+)\.[^/.]+$", k)
    return files.select(part(1).alias("sequence"), part(2).alias("camera"), part(3).cast("int").alias("number")).where("sequence != ''")


def complete_sequences(files: DataFrame, wanted: DataFrame, on: list[str], key: str) -> DataFrame:
    """Keys all of whose wanted files exist."""
    have = wanted.join(files.select(*on).distinct().withColumn("_have", F.lit(1)), on, "left")
    return have.groupBy(key).agg(F.count("_have").alias("found"), F.count("*").alias("expected")).where("found = expected").select(key)
