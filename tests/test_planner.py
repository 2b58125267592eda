"""The planner chain, the record store, configuration and the session's folder, in cases worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerbline.operators import planner, planning


def starts(spark, rows):
    return spark.createDataFrame(rows, "token string, speed double, accel double, limit double, lead_gap double, lead_speed double")


def test_ttc_fold(spark):
    rows = [
        ("a", "o1", 4, 0, 3.0, True, False),  # an infraction
        ("b", "o1", 2, 0, 3.0, False, False), ("b", "o1", 5, 0, 3.0, True, False),  # ignored after the first contact
        ("c", "o1", 5, 3, 3.0, True, False), ("c", "o1", 5, 6, 3.0, False, False),  # in front before it is ignored
        ("d", "red_light_1", 1, 0, 3.0, True, False), ("d", "o2", 1, 0, 0.001, True, False), ("d", "o3", 1, 0, 3.0, True, True),
    ]
    contacts = spark.createDataFrame(rows, "p string, object string, t int, ahead int, speed double, in_front boolean, initially_hit boolean")
    found = {r.p: (r.ttc, r.first_time) for r in planner.ttc_fold(contacts, ["p"]).collect()}
    assert found == {"a": (0.0, pytest.approx(0.4)), "b": (1.0, float("inf")), "c": (0.0, pytest.approx(0.5)), "d": (1.0, float("inf"))}


def test_brake_speed(spark):
    rows = [(5.0, 0.0, 1.1 * (5 - 4.05)), (0.3, 0.0, 1.1 * (0.3 - 3.0)), (0.1, 0.5, -0.9), (0.0, -3.0, 2.4)]
    frame = spark.createDataFrame(rows, "v double, a double, want double")
    for r in frame.select("want", planner.brake_speed(F.col("v"), F.col("a")).alias("got")).collect():
        assert r.got == pytest.approx(r.want)


def test_extension_goes_on_where_the_proposal_ends(spark):
    begin = starts(spark, [("a", 5.0, 0.0, None, 30.0, 4.0)])
    winners = spark.createDataFrame([("a", 7)], "token string, proposal int")
    whole = planning.idm_rollout(5.0, 15.0 * 0.6, 30.0, 4.0, 50, 0.1)  # proposal 7 of 15: middle path, third fraction
    found = {r.t: (r.s, r.speed, r.offset) for r in planner.extended(begin, winners).collect()}
    assert sorted(found) == list(range(41, 51))
    assert all(found[t][0] == pytest.approx(whole[t - 1][0]) and found[t][1] == pytest.approx(whole[t - 1][1]) and found[t][2] == 0.0 for t in found)


def test_plan(spark):
    begin = starts(spark, [("free", 8.0, 0.0, None, 500.0, 10.0), ("blocked", 4.0, 0.0, None, 0.5, 0.0)])
    scores = {(r.token, r.proposal): r for r in planner.closed_loop(begin).collect()}
    assert len(scores) == 30 and all(0 <= r.score <= 1 for r in scores.values())
    free = max((r for r in scores.values() if r.token == "free"), key=lambda r: (r.score, -r.proposal))
    assert free.proposal % 5 == 4 and free.ttc == 1.0  # full speed where nothing is in the way
    assert all(r.ttc == 0.0 and r.first_time <= 2.0 for r in scores.values() if r.token == "blocked")
    found = planner.plan(begin)
    by = {t: sorted((r.t, r.x, r.y) for r in found.where(F.col("token") == t).collect()) for t in ("free", "blocked")}
    assert [t for t, _, _ in by["free"]] == list(range(1, 51)) and [t for t, _, _ in by["blocked"]] == list(range(0, 51))
    stop = 1.1 * (4.0 - 4.05)
    assert all(x == pytest.approx(stop * t * 0.1) and y == 0.0 for t, x, y in by["blocked"])


def test_configuration():
    from kerbline.plans import builders, config

    made = config.instantiate({"agents": [{"_target_": "agent.constant_velocity", "steps": 3, "dt": 0.5}, {"_target_": "agent.ground_truth"}], "name": "x"})
    assert [a.name for a in made["agents"]] == ["constant_velocity", "ground_truth"] and made["name"] == "x" and isinstance(made["agents"][0], builders.Agent)
    with pytest.raises(ValueError):
        config.instantiate({"_target_": "os.system", "command": "true"})


def test_sampling_scheme_extremes(spark):
    from kerbline.operators import filters

    rows = [("a", i, float(i), float(10 - i) if i else 0.0) for i in range(10)] + [("b", i, float(i), None) for i in range(10)]
    frame = spark.createDataFrame(rows, "agent string, idx int, logit double, distance double")
    pick = lambda scheme, k: {r.agent: r.idx for r in filters.sampled_token(frame, "agent", "logit", "distance", "idx", k, 1.0, 3, scheme).collect()}
    assert pick("topk_prob", 1) == {"a": 9, "b": 9}
    assert pick("topk_dist_sampled_with_prob", 1) == {"a": 0, "b": 9}
    assert pick("topk_prob_sampled_with_dist", 1) == {"a": 9, "b": 9}
    with pytest.raises(ValueError):
        pick("nearest", 1)


def test_one_emitted_grid_point_per_step(spark):
    from kerbline.operators import sequence

    states = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.5, 5.0), ("a", 1.0, 6.0)], "k string, t double, x double")
    found = {r.k: r.x for r in sequence.to_grid(states.withColumnRenamed("k", "log"), "log", "t", ["x"], F.lit(0.0), 0.25, 6).collect()}
    assert found == {0: 0.0, 1: 2.5, 2: 5.0, 3: 5.5, 4: 6.0, 5: 6.0, 6: 6.0}
