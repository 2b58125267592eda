"""Polynomial fits, breadth-first paths, reports in one pass and generators that fail, against plain versions."""

from __future__ import annotations

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import fits, graph, scoring
from kerbline.operators.planning import savgol_matrix
from kerbline.plans import builders


@pytest.mark.parametrize("window,order,derivative", [(5, 2, 1), (8, 2, 0), (15, 2, 2), (41, 2, 1), (7, 1, 0), (4, 1, 1), (3, 0, 0), (1, 2, 0)])
def test_local_fits(spark, window, order, derivative):
    rng = np.random.default_rng(window)
    series = {f"s{n}": rng.normal(0, 5, n) + np.arange(n) * 0.3 for n in (1, 2, 3, 4, 7, 40, 41, 90)}
    rows = [(k, i + 1000, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    found = fits.local_fit(spark.createDataFrame(rows, "k string, at int, v double"), "k", "at", "v", window, order, derivative, 0.5).collect()
    got = {(r.k, r.at - 1000): r.fitted for r in found}
    assert len(got) == len(rows)
    for k, values in series.items():
        want = savgol_matrix(len(values), window, order, derivative, 0.5) @ values
        assert [got[k, i] for i in range(len(values))] == pytest.approx(want.tolist(), abs=1e-7)


def test_global_fits(spark):
    rng = np.random.default_rng(1)
    series = {f"s{n}": rng.normal(0, 5, n) for n in (1, 2, 3, 41, 300)}
    rows = [(k, i, float(v)) for k, values in series.items() for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "k string, at int, v double")
    for derivative in (0, 1, 2):
        got = {(r.k, r.at): r.fitted for r in fits.global_fit(frame, "k", "at", "v", 2, derivative, 0.1).collect()}
        for k, values in series.items():
            want = savgol_matrix(len(values), len(values), 2, derivative, 0.1) @ values
            assert [got[k, i] for i in range(len(values))] == pytest.approx(want.tolist(), abs=1e-6)
    assert fits.global_fit(frame.limit(0), "k", "at", "v").collect() == []
    with pytest.raises(ValueError):
        fits.local_fit(frame, "k", "at", "v", 5, 3)


def queued(out, start, goals, max_depth):
    """The search with a plain queue that holds a node once for each way to it."""
    queue, parent, end, depth, found = deque([(start, 1)]), {(start, 1): None}, (start, 1), 1, False
    while queue:
        node, depth = queue.popleft()
        if depth > max_depth:
            break
        if node in goals:
            end, found = (node, depth), True
            break
        for other in out.get(node, []):
            queue.append((other, depth + 1))
            parent[other, depth + 1] = (node, depth)
            end = (other, depth + 1)
    path = []
    while end is not None:
        path.append(end[0])
        end = parent[end]
    return path[::-1], found


@pytest.mark.parametrize("backward", [False, True])
def test_paths_of_a_queue(spark, backward):
    rng = random.Random(5)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(30)})
    rng.shuffle(pairs)
    edges = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    out = {}
    for a, b, _ in edges:
        a, b = (b, a) if backward else (a, b)
        out.setdefault(a, []).append(b)
    starts = [(t, rng.randrange(15)) for t in range(40)]
    goals = [(t, rng.choice([rng.randrange(14), 99])) for t in range(38) for _ in range(rng.choice([1, 1, 3]))]
    found = {r.token: (list(r.path), r.found) for r in graph.search_paths(
        spark.createDataFrame(edges, "src int, dst int, place int"), spark.createDataFrame(starts, "token int, start int"), spark.createDataFrame(goals, "token int, goal int"), 5, backward
    ).collect()}
    for t, s in starts:
        assert found[t] == queued(out, s, {g for k, g in goals if k == t}, 5), t
    assert len({f for _, f in found.values()}) == 2


def test_report_tells_null_keys_from_totals(spark):
    rows = [("a", "x", True, 1.0), ("a", "x", False, 9.0), ("a", None, True, 3.0), (None, None, None, 5.0), (None, "y", True, None)]
    found = {(r.site, r.log, r.level): (r.n, r.n_valid, r.score) for r in scoring.report(spark.createDataFrame(rows, "site string, log string, valid boolean, score double"), ["site", "log"], ["score"]).collect()}
    assert found == {("a", "x", 0): (2, 1, 1.0), ("a", None, 0): (1, 1, 3.0), (None, None, 0): (1, 0, None), (None, "y", 0): (1, 1, None), ("a", None, 1): (3, 2, 2.0), (None, None, 1): (2, 1, None), (None, None, 2): (5, 3, 2.0)}


def test_retries(spark, tmp_path):
    log = str(tmp_path / "waits")

    def make(bad):
        tried = {}

        def generate(prompts):
            for p in prompts:
                tried[p] = tried.get(p, 0) + 1
            if any(p in bad for p in prompts):
                raise ValueError("bad prompt")
            if any(p == "late" and tried[p] < 3 for p in prompts):
                raise TimeoutError("late")
            return ["short"] if prompts == ["odd"] else [None if p == "none" else p.upper() for p in prompts]

        return generate

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    prompts = ["a", "late", "worse", None, "none", "b", "c"]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, prompt string").coalesce(1)
    found = {r.i: (r.cot_text, r.attempts, r.error) for r in builders.annotate_with_retries(frame, make, "prompt", batch=3, delay=2.0, sleep=wait, bad={"worse"}).collect()}
    assert found == {0: ("A", 2, None), 1: ("LATE", 3, None), 2: ("", 3, "ValueError: bad prompt"), 3: ("", 0, None), 4: ("", 1, None), 5: ("B", 1, None), 6: ("C", 1, None)}
    assert open(log).read().split() == ["2.0", "4.0", "4.0"]  # linear back-off
    assert builders.annotate_with_retries(frame.limit(0), make, "prompt", sleep=wait, bad=set()).collect() == []
    assert "flaky" in builders.BACKENDS or __import__("kerbline.plans.source_queries") and "flaky" in builders.BACKENDS
