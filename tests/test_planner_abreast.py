"""Proposals are tracked abreast where their starts lie; each as if it were alone, and no step is sent anywhere."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import planner, planning

STARTS = "token string, speed double, accel double, limit double, lead_gap double, lead_speed double"


def test_each_proposal_as_if_alone(spark, monkeypatch):
    rows = [(f"t{i}", 0.7 * i, 0.0, None if i % 2 else 9.0 + i, 3.0 + 5 * i, 1.0 * i) for i in range(7)]
    begin = spark.createDataFrame(rows, STARTS)
    monkeypatch.setattr(planning, "ABREAST", 700)  # a start or two at a time
    driven = planning.drive_proposals(begin.select("token", "speed", "limit", "lead_gap", "lead_speed"))
    found = {}
    for r in driven.collect():
        found.setdefault((r.token, r.proposal), []).append((r.t, r.x, r.y, r.heading, r.speed, r.acceleration, r.steering))
    assert len(found) == 7 * 15
    for token, speed, _, limit, gap, lead in rows:
        for p in range(15):
            path = planning.idm_rollout(speed, (limit or 15.0) * planning.FRACTIONS[p % 5], gap, lead, 40, 0.1)
            reference = np.zeros((1, 41, 4))
            reference[0, 1:, 0], reference[0, :, 1], reference[0, 0, 3], reference[0, 1:, 3] = path[:, 0], planning.LATERALS[p // 5], speed, path[:, 1]
            want = planning.simulate_states(reference, 0.1)[0]
            got = np.array(sorted(found[token, p]))
            assert got[:, 0].tolist() == list(range(41)) and got[:, 1:] == pytest.approx(want, abs=1e-9)


def test_references_of_several_lengths(spark):
    rows = [(t, p, k, 4.0 * k * 0.1, 0.0, 0.0, 4.0) for t, n in (("a", 5), ("b", 30)) for p in range(3) for k in range(n)]
    found = planning.simulate(spark.createDataFrame(rows, "token string, proposal int, t int, x double, y double, heading double, speed double").repartition(3))
    assert {(r.token, r.proposal): r["count"] for r in found.groupBy("token", "proposal").count().collect()} == {(t, p): n for t, n in (("a", 5), ("b", 30)) for p in range(3)}
    assert found.where(F.abs("y") > 1e-9).count() == 0


def test_the_chain_sends_no_steps(spark):
    begin = spark.createDataFrame([("a", 5.0, 0.0, None, 30.0, 4.0)], STARTS)
    plan = planner.closed_loop(begin)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan
