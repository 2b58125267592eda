"""Numbering of linked tables by pointers alone, and what lies along them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import linked


def table(spark, lists, extra=()):
    rows = [(t, p) for names in lists for t, p in zip(names, [None, *names[:-1]], strict=True)] + list(extra)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "token string, prev string")


def test_lists_are_numbered(spark):
    lists = [[f"{k}-{i}" for i in range(n)] for k, n in enumerate((1, 2, 3, 64, 65, 300))]
    extra = [("s0", ""), ("s1", "s0"), ("lost", "nowhere"), ("lost2", "lost")]
    cycle = [("c0", "c2"), ("c1", "c0"), ("c2", "c1"), ("tail", "c1"), ("self", "self")]
    branch = [("b", "s1"), ("b2", "b"), ("d", "s1")]
    found = {r.token: (r.head, r.idx, r.cyclic) for r in linked.rank_lists(table(spark, lists, extra + cycle + branch)).collect()}
    want = {t: (names[0], i, False) for names in lists for i, t in enumerate(names)}
    want |= {"s0": ("s0", 0, False), "s1": ("s0", 1, False), "lost": ("lost", 0, False), "lost2": ("lost", 1, False), "b": ("s0", 2, False), "b2": ("s0", 3, False), "d": ("s0", 2, False)}
    want |= {t: (None, None, True) for t in ("c0", "c1", "c2", "tail", "self")}
    assert found == want
    assert linked.rank_lists(table(spark, lists).limit(0)).collect() == []


def test_one_long_list_takes_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(linked, "cut", lambda df: calls.append(1) or df.checkpoint(eager=True))
    rows = spark.range(20_000).select(F.col("id").alias("token"), F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"))
    found = linked.rank_lists(rows)
    assert found.where("idx <> token or head <> 0 or cyclic").count() == 0 and found.count() == 20_000
    assert len(calls) <= 17  # log2(20,000) rounds and the first table


@pytest.mark.parametrize("stretch", [4096, 20])
def test_history_and_future(spark, monkeypatch, stretch):
    monkeypatch.setattr(linked, "STRETCH", stretch)
    rng = random.Random(stretch)
    lists = {f"h{k}": [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(n)] for k, n in enumerate((1, 2, 3, 20, 21, 90))}
    rows = [(h, i, x, y, 0.0) for h, points in lists.items() for i, (x, y) in enumerate(points)]
    frame = spark.createDataFrame(rows, "head string, idx long, x double, y double, heading double")
    found = {(r.head, r.idx): r for r in linked.history_and_future(frame, 3, 16).collect()}
    assert len(found) == len(rows)
    for h, points in lists.items():
        n = len(points)
        step = [b - a for a, b in zip(points[0], points[1], strict=True)] if n > 1 else [0.0, 0.0]
        at = lambda k: points[min(k, n - 1)] if k >= 0 else tuple(p + k * s for p, s in zip(points[0], step, strict=True))  # noqa: B023, E731
        for i, here in enumerate(points):
            r = found[h, i]
            assert (r.n_past, r.n_future) == (min(i, 3) + 1, min(n - 1 - i, 16) + 1)
            for got, k in zip([*r.past, *r.future], [*range(i - 3, i + 1), *range(i, i + 17)], strict=True):
                assert (got.x, got.y) == pytest.approx((at(k)[0] - here[0], at(k)[1] - here[1]))


def test_own_frame(spark):
    frame = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.5707963267948966), ("a", 1, 1.0, 3.0, 0.0)], "head string, idx long, x double, y double, heading double")
    first = linked.history_and_future(frame, 1, 1).where("idx = 0").first()
    assert [(p.x, p.y) for p in (*first.past, *first.future)] == [pytest.approx(p, abs=1e-9) for p in ((-2, 0), (0, 0), (0, 0), (2, 0))]
