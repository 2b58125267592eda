"""Builders, agents, annotators and record files."""

from __future__ import annotations


from pyspark.sql import functions as F

from kerbline.plans import builders


def test_features_are_built_once_and_complete_tokens_known(spark, tmp_path):
    scenes = spark.createDataFrame([("l1", "a", 1.0), ("l1", "b", 2.0), ("l2", "c", 3.0)], "log string, token string, speed double")
    speed = builders.Builder("speed", lambda d: d.select("log", "token", "speed"))
    double = builders.Builder("double", lambda d: d.where("token <> 'c'").select("log", "token", (F.col("speed") * 2).alias("v")))
    for _ in range(2):
        builders.cache_features(scenes, [speed, double], str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f" / "speed")).count() == 3
    assert {r.token for r in builders.usable_tokens(spark, [speed, double], str(tmp_path / "f")).collect()} == {"a", "b"}


def test_agents(spark):
    scenes = spark.createDataFrame([("a", 4.0, [(1.0, 2.0, 0.1)])], "token string, speed double, future array<struct<x:double,y:double,heading:double>>")
    assert [(r.step, r.x) for r in builders.run_agent(builders.constant_velocity(2, 0.5), scenes).collect()] == [(1, 2.0), (2, 4.0)]
    assert builders.run_agent(builders.ground_truth(), scenes).first().y == 2.0
    canned = builders.annotate(scenes, lambda c: F.when(c == "b", F.lit("text")), "token")
    assert canned.first().cot_text == ""
