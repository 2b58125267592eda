"""Hand-computed cases of the operators, sources and streaming forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.functions import classify, text
from kerbline.functions import geometry as geo
from kerbline.operators import filters, graph, planning, scenes, scoring, sequence, spatial, tokens, vocabulary
from kerbline.sources import logs, samples


def col(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# ------------------------------------------------------------------ scenes
def log(spark, sizes):
    return spark.createDataFrame([(k, i, k * 100 + i) for k, n in enumerate(sizes) for i in range(n)], "log long, idx long, token long")


@pytest.mark.parametrize(("n", "step", "starts"), [(4, 4, {0: [0], 2: [0, 4]}), (4, 2, {0: [0], 2: [0, 2, 4]}), (4, 1, {0: [0], 2: [0, 1, 2, 3, 4, 5]})])
def test_windows_keep_full_ones_only(spark, n, step, starts):
    got = {}
    for r in scenes.frame_windows(log(spark, [4, 3, 9]), n, step, current=1).collect():
        got.setdefault(r.log, []).append(r.start)
        assert r.token == r.log * 100 + r.start + 1 and list(r.tokens) == [r.log * 100 + r.start + i for i in range(n)]
    assert {k: sorted(v) for k, v in got.items()} == starts


def test_keep_last_and_parts(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], "k int, o int, v string")
    assert {r.k: r.v for r in scenes.keep_last(rows, ["k"], ["o"]).collect()} == {1: "b", 2: "c"}
    parts = [r.part for r in scenes.equal_parts(spark.range(17), 5, ["id"]).orderBy("id").collect()]
    assert parts == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 5
    assert scenes.equal_parts(spark.range(0), 5, ["id"]).collect() == []


def test_set_equality(spark):
    a, b = spark.range(3).withColumnRenamed("id", "t"), spark.range(1, 5).withColumnRenamed("id", "t")
    r = scenes.set_difference_counts(a, b, "t").first()
    assert (r.missing, r.unused, r.shared, r.equal) == (1, 2, 2, False)
    assert scenes.set_difference_counts(a, a, "t").first().equal


# ------------------------------------------------------------------ scores
def test_worked_score(spark):
    score = scoring.gated_score([F.lit(1.0), F.lit(1.0)], [(F.lit(m), w) for m, w in ((0.8, 5.0), (1.0, 5.0), (0.0, 2.0), (1.0, 0.0))])
    assert col(spark, score) == pytest.approx(0.75)


def test_progress_is_normalised_over_the_group(spark):
    rows = spark.createDataFrame([("a", 10.0, 1.0), ("a", 5.0, 1.0), ("a", 8.0, 0.0), ("b", 4.0, 1.0), ("b", 3.0, 0.0)], "t string, raw double, gate double")
    got = sorted((r.t, r.raw, r.progress) for r in scoring.normalised_progress(rows, "raw", F.col("gate"), "t").collect())
    assert got == [("a", 5.0, 0.5), ("a", 8.0, 0.0), ("a", 10.0, 1.0), ("b", 3.0, 0.0), ("b", 4.0, 1.0)]


def test_average_row_skips_nulls(spark):
    rows = spark.createDataFrame([("x", True, 1.0), ("y", False, None)], "token string, valid boolean, m double")
    total = {r.token: r for r in scoring.with_average(rows, "token", ["m"]).collect()}["average"]
    assert total.m == 1.0 and total.valid is False


def test_fault_fold_equals_the_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(3)), int(rng.integers(4)), k, bool(rng.integers(2))) for k in range(200)]
    counted, ignored = set(), set()
    for p, o, k, fault in rows:
        if (p, o) in ignored:
            continue
        if fault:
            counted.add(k)
        else:
            ignored.add((p, o))
    got = scoring.counted_faults(spark.createDataFrame(rows, "p int, o int, k int, fault boolean"), ["p", "o"], "k", "fault").where("counts")
    assert {r.k for r in got.collect()} == counted


def test_strict_bounds(spark):
    assert [col(spark, scoring.strict_bounds(F.lit(v), -1.0, 2.0)) for v in (-1.0, 0.0, 2.0)] == [False, True, False]
    assert col(spark, scoring.strict_bounds(F.lit(99.0), None, 0)) is True


def test_first_infraction_is_infinite_without_one(spark):
    rows = spark.createDataFrame([(1, 5, True), (1, 3, True), (2, 1, False)], "p int, t int, bad boolean")
    assert {r.p: r.first_time for r in scoring.first_infraction(rows, ["p"], F.col("bad"), "t", 0.5).collect()} == {1: 1.5, 2: math.inf}


# ------------------------------------------------------------------ geometry and space
def box(x, y, h, length, width):
    return [(F.lit(float(a)), F.lit(float(b))) for a, b in corners(x, y, h, length, width)]


def corners(x, y, h, length, width):
    return [(x + a * length / 2 * math.cos(h) - b * width / 2 * math.sin(h), y + a * length / 2 * math.sin(h) + b * width / 2 * math.cos(h)) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]


@pytest.mark.parametrize(("other", "hit"), [((3.0, 0.0, 0.0), True), ((4.0, 0.0, 0.0), True), ((4.01, 0.0, 0.0), False), ((2.9, 1.9, math.pi / 4), True), ((3.4, 2.4, math.pi / 4), True), ((3.45, 2.45, math.pi / 4), False)])
def test_boxes_touch(spark, other, hit):
    assert col(spark, geo.boxes_intersect(box(0, 0, 0, 4, 2), box(*other, 4, 2))) is hit


def test_point_in_concave_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    inside = lambda x, y: col(spark, geo.point_in_ring(F.lit(x), F.lit(y), ring))
    assert [inside(1.0, 0.5), inside(2.0, 2.0), inside(3.5, 2.0), inside(5.0, 1.0)] == [True, False, True, False]


def test_local_and_global_are_inverse(spark):
    local = geo.to_local(*map(F.lit, (3.0, 4.0, 2.0, 1.0, 1.0, 0.5)))
    back = geo.to_global(*local, *map(F.lit, (1.0, 1.0, 0.5)))
    assert [col(spark, c) for c in back] == pytest.approx([3.0, 4.0, 2.0])
    assert col(spark, geo.wrap_angle(F.lit(math.pi))) == pytest.approx(-math.pi)
    assert col(spark, geo.align_two_points(*map(F.lit, (1.0, 0.0, 0.0, 2.0)))) == pytest.approx(math.pi / 2)
    assert col(spark, geo.quaternion_yaw(*map(F.lit, (math.cos(0.4), 0.0, 0.0, math.sin(0.4))))) == pytest.approx(0.8)


def test_box_join_gives_each_pair_once(spark):
    rng = np.random.default_rng(1)
    a = [(i, *map(float, rng.uniform(-30, 30, 2)), float(rng.uniform(-3, 3))) for i in range(40)]
    b = [(i, *map(float, rng.uniform(-30, 30, 2)), float(rng.uniform(-3, 3))) for i in range(40)]
    make = lambda rows, p, key: spatial.with_box(spark.createDataFrame(rows, f"{key} int, x double, y double, heading double"), p, 9.0, 3.0).drop("x", "y", "heading").withColumn("t", F.lit(0))
    got = sorted((r.i, r.j) for r in spatial.box_join(make(a, "a", "i"), make(b, "b", "j"), ["t"], 5).collect())

    def meet(p, q):
        for first in (p, q):
            for k in (0, 1):
                n = np.array([first[k + 1][1] - first[k][1], first[k][0] - first[k + 1][0]])
                u, v = np.array(p) @ n, np.array(q) @ n
                if u.max() < v.min() or v.max() < u.min():
                    return False
        return True

    assert got == sorted((i, j) for i, *pa in a for j, *pb in b if meet(corners(*pa, 9, 3), corners(*pb, 9, 3)))


# ------------------------------------------------------------------ sequences
def test_gap_fill_and_unwrap(spark):
    rows = spark.createDataFrame([(1, i, v, m) for i, (v, m) in enumerate([(5.0, False), (1.0, True), (9.0, False), (2.0, True), (7.0, False)])] + [(2, 0, 3.0, False)], "g int, i int, v double, m boolean")
    got = [r.filled for r in sequence.fill_static(rows, "v", F.col("m"), "g", "i").orderBy("g", "i").collect()]
    assert got == [1.0, 1.0, 1.0, 2.0, 2.0, 0.0]
    angles = [0.0, 3.0, -3.0, -1.0, 2.5, -2.5]
    frame = spark.createDataFrame([(1, i, a) for i, a in enumerate(angles)], "g int, i int, a double")
    assert [r.unwrapped for r in sequence.phase_unwrap(frame, "a", "g", "i").orderBy("i").collect()] == pytest.approx(list(np.unwrap(angles)))


def test_interpolation_stays_inside_the_range(spark):
    rows = spark.createDataFrame([("a", 5, 0.0), ("a", 25, 2.0), ("b", 20, 7.0), ("c", 21, 1.0)], "k string, t long, v double")
    assert sorted(map(tuple, sequence.interpolate(rows, "t", ["v"], "k", 10).collect())) == [("a", 10, 0.5), ("a", 20, 1.5), ("b", 20, 7.0)]


def test_future_indices():
    assert sequence.future_indices(4.0, 0.1, 8) == [5, 10, 15, 20, 25, 30, 35, 40]


def test_path_between_cuts_where_few_points_lie_inside(spark):
    rows = spark.createDataFrame([("a", float(s), s * 2.0) for s in range(5)], "k string, s double, x double")
    got = sorted((r.s, r.x) for r in sequence.path_between(rows, "k", F.lit(1.2), F.lit(1.6), ["x"]).collect())
    assert [v for p in got for v in p] == pytest.approx([1.2, 2.4, 1.6, 3.2])


# ------------------------------------------------------------------ codebook
def test_tokenise_and_roll_out_again(spark):
    words = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 0.05, 0.1)], "token_id int, x double, y double, h double").select(
        "token_id", tokens.corners_array(F.col("x"), F.col("y"), F.col("h")).alias("corners")
    )
    seq = spark.createDataFrame([("t", [1, 2, 0, 2])], "k string, tokens array<int>")
    poses = tokens.rollout(seq, words, "k")
    again = tokens.tokenise(poses, words, "k").first()
    assert list(again.tokens) == [1, 2, 0, 2]
    assert poses.first().poses[-1].heading == pytest.approx(0.2)


def test_disk_clusters_stay_within_tolerance_and_stop_early(spark):
    points = spark.createDataFrame([(i, float(i // 5) * 3, 0.0, 0.0) for i in range(15)], "segment_id int, x double, y double, heading double")
    got = tokens.disk_clusters(points, 10, 0.5).collect()
    assert [(r.x, r.members) for r in got] == [(0.0, 5), (3.0, 5), (6.0, 5)]


def _plain_clusters(rows, n, tolerance):
    corners = lambda x, y, h: [(x + a * 2.25 * np.cos(h) - b * np.sin(h), y + a * 2.25 * np.sin(h) + b * np.cos(h)) for a, b in ((1, 1), (1, -1), (-1, -1), (-1, 1))]
    left, out = sorted(rows), []
    while left and len(out) < n:
        seed = corners(*left[0][1:])
        near = [r for r in left if sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(corners(*r[1:]), seed, strict=True)) / 4 <= tolerance]
        out.append((len(out), *(float(np.mean([r[k] for r in near])) for k in (1, 2, 3)), len(near)))
        left = [r for r in left if r not in near]
    return out


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_disk_clusters_are_the_plain_ones_whatever_the_chunk(spark, chunk):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(0, (1.0, 0.5, 0.2)))) for i in range(200)]
    want = _plain_clusters(rows, 12, 0.6)
    odd = [(-3, float("nan"), 0.0, 0.0), (-2, None, 0.0, 0.0), (-1, float("inf"), 0.0, 0.0)]
    got = tokens.disk_clusters(spark.createDataFrame(rows + odd, "segment_id int, x double, y double, heading double"), 12, 0.6, chunk=chunk).collect()
    assert [tuple(r) for r in got] == [pytest.approx(w) for w in want]


def test_disk_clusters_of_nothing(spark):
    assert tokens.disk_clusters(spark.createDataFrame([], "segment_id int, x double, y double, heading double"), 5, 0.5).collect() == []


def test_token_text(spark):
    assert col(spark, text.action_text(F.array(F.lit(3), F.lit(12)))) == "<action_3><action_12>"
    assert list(col(spark, text.action_ids(F.lit("a<action_3> <action_12>")))) == [3, 12]
    assert list(col(spark, tokens.decode_ids(F.array(F.lit(5), F.lit(103)), 100, 4))) == [0, 3, 0, 0]
    assert list(col(spark, classify.label_mask(F.array(*map(F.lit, (7, 1, 9))), F.lit(1)))) == [-100, 1, 9]
    assert list(col(spark, classify.completion_mask(F.array(*map(F.lit, (7, 2, 9))), F.lit(2)))) == [1, 1, 0]


# ------------------------------------------------------------------ planning
def test_savgol_is_exact_on_its_polynomials():
    t = np.arange(12.0)
    for window, order in ((5, 2), (8, 3), (12, 3)):
        assert planning.smooth(t**2, window, order) == pytest.approx(t**2)
        assert planning.smooth(t**2, window, order, 1, 0.5) == pytest.approx(2 * t / 0.5)


def test_idm_stops_behind_a_standing_lead_and_reaches_its_target():
    assert planning.idm_rollout(10.0, 15.0, 60.0, 0.0, 400, 0.1)[-1, 1] == pytest.approx(0, abs=0.2)
    assert planning.idm_rollout(0.0, 10.0, 1e9, 50.0, 600, 0.1)[-1, 1] == pytest.approx(10, abs=0.5)


def test_tracker_follows_straight_and_curved_references(spark):
    t = np.arange(60) * 0.1
    straight = np.stack([5 * t, 0 * t, 0 * t, 5 + 0 * t], axis=1)
    turn = np.stack([20 * np.sin(5 * t / 20), 20 - 20 * np.cos(5 * t / 20), 5 * t / 20, 5 + 0 * t], axis=1)
    states = planning.simulate_states(np.stack([straight, turn]), 0.1)
    off = np.hypot(states[:, :, 0] - np.stack([straight, turn])[:, :, 0], states[:, :, 1] - np.stack([straight, turn])[:, :, 1])
    assert off.max() < 1.5
    assert planning.emergency_brake(1.0, 4.0) and not planning.emergency_brake(3.0, 4.0)


# ------------------------------------------------------------------ graph and vocabulary
def test_lane_paths_and_route_repair(spark):
    lanes = spark.createDataFrame([("t", x, b, n) for x, b, n in (("a", "A", 1.0), ("b", "B", 5.0), ("c", "B", 1.0), ("d", "C", 1.0))], "token string, lane_id string, roadblock_id string, length double")
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "a", "c"), ("t", "b", "d"), ("t", "c", "d")], "token string, src string, dst string")
    found = graph.lane_paths(spark.createDataFrame([("t", "a", "C")], "token string, start_lane string, goal_block string"), lanes, edges).first()
    assert list(found.lanes) == ["a", "c", "d"] and found.found
    lost = graph.lane_paths(spark.createDataFrame([("t", "a", "Z")], "token string, start_lane string, goal_block string"), lanes, edges).first()
    assert list(lost.lanes) == ["a", "c", "d"] and not lost.found
    assert graph.repaired_route(["B", "D"], {"A": ["B"], "B": ["C"], "C": ["D"]}, start="A") == ["A", "B", "C", "D"]
    assert graph.repaired_route(["A", "B", "A", "C"], {"A": ["B", "C"], "B": ["A"]}) == ["A", "C"]


def test_vocabulary_checks(spark):
    child, parent = spark.createDataFrame([("r1", "f1"), ("r2", "zz")], "r string, f string"), spark.createDataFrame([("f1",), ("f1",)], "n string")
    assert [tuple(r) for r in vocabulary.missing_references(child, ["f"], parent, ["n"], "fk").collect()] == [("fk", "zz")]
    assert [tuple(r) for r in vocabulary.repeats(parent, ["n"], "twice").collect()] == [("twice", "f1")]


def test_sensor_projection(spark):
    rows = spark.createDataFrame([(0, "a", "l"), (1, "b", "m")], "idx int, cam string, lidar string")
    out = filters.with_sensors(rows, {"cam": [1], "lidar": False}).orderBy("idx").collect()
    assert [r.cam for r in out] == [None, "b"] and "lidar" not in out[0].asDict()


# ------------------------------------------------------------------ sources
def test_samples_unify_scalars_and_lists(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text('{"token": "x", "velocity": 1.5, "cot_output": "", "acceleration": [1, 2]}')
    (tmp_path / "a" / "2.json").write_text('{"token": "y", "velocity": [3, 4], "cot_output": ["a", "b"]}')
    (tmp_path / "a" / "3.json").write_text('{"token": "z", "cot_output": []}')
    got = {r.token: r for r in samples.read_samples(spark, {str(tmp_path / "a"): "/sensors"}).collect()}
    assert list(got["x"].velocity) == [1.5] and list(got["y"].velocity) == [3.0, 4.0] and got["z"].velocity is None
    assert (got["x"].has_cot, got["y"].cot_text, got["z"].has_cot) == (True, "a\nb", False) and got["x"].sensor_root == "/sensors"


def test_log_round_trip_index_and_submissions(spark, tmp_path):
    rows = spark.createDataFrame([("l1", "t1", 0), ("l2", "t2", 1)], "log_name string, token string, frame_idx int")
    logs.write_log(rows, str(tmp_path / "log"))
    assert [r.token for r in logs.read_log(spark, str(tmp_path / "log"), ["l2"]).collect()] == ["t2"]
    logs.write_index(spark.createDataFrame([("/c/log/kind/t9/cache.bin",)], "path string"), str(tmp_path / "idx"))
    assert logs.cache_index(spark, str(tmp_path / "idx")).first().token == "t9"
    sub = spark.createDataFrame([(0, "t1", [1.0]), (0, "t2", [2.0])], "seed int, token string, poses array<double>")
    logs.write_submission(sub, str(tmp_path / "sub"), "us")
    read = logs.read_submission(spark, str(tmp_path / "sub"))
    assert logs.merge_submissions([read, read], rows).count() == 4
    with pytest.raises(ValueError, match="lacks"):
        logs.merge_submissions([read.where("token = 't1'")], rows)
    logs.write_submission(sub.withColumn("seed", F.monotonically_increasing_id()), str(tmp_path / "two"), "us")
    with pytest.raises(ValueError, match="one seed"):
        logs.read_submission(spark, str(tmp_path / "two"))


def test_annotations_must_have_one_length(spark):
    ddl = "log_name string, token string, frame_idx int, anns struct<gt_boxes:array<array<double>>,gt_names:array<string>,gt_velocity_3d:array<array<double>>,instance_tokens:array<string>,track_tokens:array<string>>"
    good = spark.createDataFrame([("l", "t", 0, ([[1.0]], ["car"], [[0.0]], ["i"], ["k"]))], ddl)
    assert logs.annotations_long(good).first().name == "car"
    with pytest.raises(Exception, match="differ in length"):
        logs.annotations_long(spark.createDataFrame([("l", "t", 0, ([[1.0]], ["car", "bus"], [[0.0]], ["i"], ["k"]))], ddl)).collect()


# ------------------------------------------------------------------ streaming
def test_count_windows_equal_the_batch_form(spark, sf_dir, tmp_path):
    from kerbline.streaming import windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet".replace("events.parquet", "event*"))
    q = windows.count_windows(stream, "user_id", 10).writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    per = {r.user_id: r["count"] // 10 for r in events.groupBy("user_id").count().collect()}
    got = {r.key: r["count"] for r in spark.table("chunks").groupBy("key").count().collect()}
    assert got == {k: v for k, v in per.items() if v}


def test_overlap_area_and_loop():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    moved = [(x + 1, y + 1) for x, y in square]
    far = [(x + 9, y) for x, y in square]
    assert graph.convex_overlap(square, moved) == pytest.approx(1.0) and graph.convex_overlap(square, far) == 0
    assert graph.first_loop([square, far, [(x + 0.5, y) for x, y in square]]) == 2 and graph.first_loop([square, moved]) is None


def test_rigid_inverse(spark):
    q, shift = tuple(map(F.lit, (0.5, 0.5, 0.5, 0.5))), tuple(map(F.lit, (1.0, 2.0, 3.0)))
    there = geo.rigid(q, shift, tuple(map(F.lit, (4.0, 5.0, 6.0))))
    assert [col(spark, c) for c in geo.rigid_inverse(q, shift, there)] == pytest.approx([4.0, 5.0, 6.0])


def test_initial_hits_and_short_records(spark):
    from kerbline.operators import forecast

    pairs = spark.createDataFrame([("a", 0, "k", False), ("a", 0, "red_light_1", False), ("a", 0, "red_light_2", True), ("a", 1, "m", True)], "token string, t int, track_token string, inside boolean")
    assert {r.track_token for r in forecast.initially_hit(pairs, F.col("inside"), "token").collect()} == {"k", "red_light_2"}
    rows = spark.createDataFrame([("a", 0, "k", "car", 1.0, 0.0, 0.0), ("a", 1, "k", "van", 2.0, 0.0, 0.0)], "token string, t int, track_token string, type string, x double, y double, heading double")
    assert {r.type for r in forecast.recorded_occupancy(rows, "token", 1).collect()} == {"car"}
    with pytest.raises(Exception, match="too early"):
        forecast.recorded_occupancy(rows, "token", 5).collect()
