"""Searches on lanes and routes: many tokens a batch, nothing sent whole to the driver, whatever sizes are guessed."""

from __future__ import annotations

import pytest

from kerbline.operators import graph
from kerbline.queries import QUERIES


@pytest.mark.parametrize("name", ["lane_paths", "route_repair"])
def test_no_broadcast_and_no_frame_a_token(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CoGroup" not in plan


def test_costs_and_tokens_without_lanes_or_edges(spark):
    lanes = spark.createDataFrame([(t, x, b, n) for t in "tu" for x, b, n in (("a", "A", 7.0), ("b", "B", 5.0), ("c", "B", 1.0), ("d", "C", 2.0))], "token string, lane_id string, roadblock_id string, length double")
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "c"), ("t", "b", "d"), ("t", "c", "d"), ("t", "a", None)], "token string, src string, dst string")
    asked = spark.createDataFrame([("t", "a", "C"), ("u", "a", "C"), ("v", "a", "C")], "token string, start_lane string, goal_block string")
    found = {r.token: (list(r.lanes), r.found, r.cost) for r in graph.lane_paths(asked, lanes, edges).collect()}
    assert found == {"t": (["a", "c", "d"], True, 4.0), "u": (["a"], False, 1.0)}
    astray = spark.createDataFrame([("t", "z", "C")], asked.schema)
    assert [(list(r.lanes), r.found, r.cost) for r in graph.lane_paths(astray, lanes, edges).collect()] == [([], False, None)]
    routes = spark.createDataFrame([("t", "a", ["a", "d"]), ("t", "b", ["b", "d"]), ("w", "a", ["x", "y"])], "token string, start string, blocks array<string>")
    assert sorted((r.token, list(r.blocks)) for r in graph.repair_routes(routes, edges).collect()) == [("t", ["a", "b", "d"]), ("t", ["b", "d"]), ("w", ["x", "y"])]
