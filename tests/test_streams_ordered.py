"""Stateful streams: late rows, restarts, nulls, against the plain form."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from kerbline.streaming import ordered

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, log string, ts timestamp, value double"


def _row(minute, key, token, value):
    return token, key, None if minute is None else START + dt.timedelta(minutes=minute), value


def _run(spark, tmp_path, batches, operator):
    """Each batch is a file and a run of its own: the job stops in between and goes on from its notes."""
    own = ordered.state_session(spark, 2)
    source, target, notes = (str(tmp_path / n) for n in ("source", "target", "notes"))
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ordered.drain(operator(own.readStream.schema(SCHEMA).parquet(source)), target, notes)
    return spark.read.parquet(target)


def _by_key(rows, until):
    keys = defaultdict(list)
    for token, key, ts, value in rows:
        if ts is not None and ts < until:
            keys[key].append((ts, token is not None, token or 0, value))
    return {k: [(r[2] if r[1] else None, r[3]) for r in sorted(v, key=lambda r: r[:3])] for k, v in keys.items()}


BATCHES = [
    [_row(3, "a", 3, 1.0), _row(1, "a", 1, 2.0), _row(2, None, 2, None), _row(0, "a", 9, 4.0), _row(None, "a", 77, 5.0), _row(3, "a", 2, 8.0), _row(30, "b", 5, 1.5)],
    # minutes 21 to 24 come after minute 30: late, but not later than the watermark (20)
    [_row(24, "a", 24, 16.0), _row(21, "a", 21, None), _row(22, "a", None, 32.0), _row(22, "a", 22, 64.0), _row(31, None, 31, 3.0), _row(32, None, 33, 5.0)],
    [_row(31, "b", 6, 2.5), _row(31, "b", 6, 2.5), _row(60, "b", 7, 7.0), _row(33, None, 34, None)],
]
UNTIL = START + dt.timedelta(minutes=50)


def test_hopping_count_windows_over_restarts(spark, tmp_path):
    found = _run(spark, tmp_path, BATCHES, lambda s: ordered.ordered_count_windows(s, "log", "ts", "id", "value", 3, 2, "10 minutes"))
    got = {(r.key, r.start): (r.first_token, r.last_token, r.total) for r in found.collect()}
    plain = {}
    for key, rows in _by_key([r for b in BATCHES for r in b], UNTIL).items():
        for i in range(0, len(rows) - 2, 2):
            values = [v for _, v in rows[i : i + 3] if v is not None]
            plain[key, i] = (rows[i][0], rows[i + 2][0], sum(values) if values else None)
    assert found.count() == len(got) and got == plain and len(plain) > 4


def test_sliding_mean_is_given_once_it_is_full(spark, tmp_path):
    found = _run(spark, tmp_path, BATCHES, lambda s: ordered.ordered_sliding_mean(s, "log", "ts", "id", "value", 2, "10 minutes"))
    got = {(r.key, r.idx): (r.token, r["mean"]) for r in found.collect()}
    plain = {}
    for key, rows in _by_key([r for b in BATCHES for r in b], UNTIL).items():
        for i in range(1, len(rows)):
            values = [v for _, v in rows[i - 1 : i + 1] if v is not None]
            plain[key, i] = (rows[i][0], sum(values) / len(values) if values else None)
    assert found.count() == len(got) and got == plain


def test_rows_behind_the_watermark_are_dropped_and_windows_of_one_row_work(spark, tmp_path):
    batches = [[_row(0, "a", 1, 1.0), _row(60, "a", 2, 2.0)], [_row(5, "a", 3, 9.0), _row(90, "a", 4, 4.0)]]
    found = _run(spark, tmp_path, batches, lambda s: ordered.ordered_count_windows(s, "log", "ts", "id", "value", 1, None, "10 minutes"))
    assert [(r.start, r.total) for r in found.orderBy("start").collect()] == [(0, 1.0), (1, 2.0)]


def test_the_given_session_keeps_its_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    ordered.state_session(spark, 77)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.range(1).select(F.lit(1)).count() == 1
