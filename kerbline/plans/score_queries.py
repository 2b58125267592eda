"""Scores, classes and spatial joins, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import classify
from kerbline.operators import scenes, scoring, sequence, spatial
from kerbline.registry import frames, poses, query, r6, table

# ------------------------------------------------------------------ the flagship: score table with a summary row
_SCORES_SQL = """chunks AS (SELECT log, idx // 14 AS chunk, max(token) FILTER (WHERE idx % 14 = 3) AS token,
count(*) FILTER (WHERE event_type = 'error') < 7 AS valid, CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 5 THEN 0e0 ELSE 1e0 END AS collision, CASE WHEN max(value) > 300 THEN 0e0 ELSE 1e0 END AS area,
sum(value) / 100 AS raw, CASE WHEN min(value) < 1 THEN 0e0 ELSE 1e0 END AS ttc, CASE WHEN max(value) - min(value) < 150 THEN 1e0 ELSE 0e0 END AS comfort
FROM frames GROUP BY ALL HAVING count(*) = 14),
top AS (SELECT *, max(raw * collision * area) OVER (PARTITION BY log) AS best FROM chunks),
progressed AS (SELECT *, CASE WHEN best > 5 THEN raw * collision * area / best WHEN collision * area = 0 THEN 0 ELSE 1 END AS progress FROM top),
scored AS (SELECT log, chunk, token, valid, collision, area, progress, ttc, comfort, collision * area * (progress * 5 + ttc * 5 + comfort * 2) / 12 AS score FROM progressed)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per window: gates, normalised progress, weighted terms and the score."""
    value = F.col("value")
    gate = lambda bad: F.when(bad, 0.0).otherwise(1.0)
    chunks = scenes.tumbling(
        frames(spark, sf_dir),
        14,
        [
            F.max(F.when(F.col("idx") % 14 == 3, F.col("token"))).alias("token"),
            (F.count_if(F.col("event_type") == "error") < 7).alias("valid"),
            gate(F.count_if(F.col("event_type") == "error") >= 5).alias("collision"),
            gate(F.max(value) > 300).alias("area"),
            (F.sum(value) / 100).alias("raw"),
            gate(F.min(value) < 1).alias("ttc"),
            gate(F.max(value) - F.min(value) >= 150).alias("comfort"),
        ],
    )
    gates = F.col("collision") * F.col("area")
    progressed = scoring.normalised_progress(chunks, "raw", gates, "log")
    terms = [(F.col(n), scoring.WEIGHTS[n]) for n in ("progress", "ttc", "comfort")]
    return progressed.withColumn("score", scoring.gated_score([gates], terms))


@query("pdm_score", f"WITH {{frames}}, {_SCORES_SQL} SELECT log, chunk, token, collision, area, ttc, comfort, round(score, 6) AS score FROM scored")
def pdm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("log", "chunk", "token", "collision", "area", "ttc", "comfort", r6("score").alias("score"))


@query("pdm_progress_norm", f"WITH {{frames}}, {_SCORES_SQL} SELECT log, chunk, round(progress, 6) AS progress FROM scored")
def pdm_progress_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).select("log", "chunk", r6("progress").alias("progress"))


@query(
    "score_summary",
    f"""WITH {{frames}}, {_SCORES_SQL} SELECT CAST(token AS VARCHAR) AS token, valid, collision, area, round(progress, 6) AS progress, ttc, comfort, round(score, 6) AS score FROM scored
UNION ALL SELECT 'average', bool_and(valid), round(avg(collision), 6), round(avg(area), 6), round(avg(progress), 6), round(avg(ttc), 6), round(avg(comfort), 6), round(avg(score), 6) FROM scored""",
)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = ["collision", "area", "progress", "ttc", "comfort", "score"]
    rows = scoring.with_average(scores(spark, sf_dir), "token", metrics)
    return rows.select("token", "valid", *[r6(m).alias(m) for m in metrics])


@query(
    "best_proposal",
    f"WITH {{frames}}, {_SCORES_SQL} SELECT log, chunk, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY log ORDER BY score DESC, chunk) = 1",
)
def best_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_proposal(scores(spark, sf_dir), "log", "score", "chunk").select("log", "chunk", r6("score").alias("score"))


@query(
    "comfort_bounds",
    """WITH {frames} SELECT log, idx // 14 AS chunk, bool_and(value > -4.05e0 AND value < 250) AS longitudinal, bool_and(value < 200) AS lateral, bool_and(value > -4.05e0 AND value < 250) AND bool_and(value < 200) AS comfortable
FROM frames GROUP BY ALL HAVING count(*) = 14""",
)
def comfort_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scoring.strict_bounds(F.col("value"), -4.05, 250.0), scoring.strict_bounds(F.col("value"), 0.0, 200.0)
    out = scenes.tumbling(frames(spark, sf_dir), 14, [F.bool_and(a).alias("longitudinal"), F.bool_and(b).alias("lateral")])
    return out.select("log", "chunk", "longitudinal", "lateral", (F.col("longitudinal") & F.col("lateral")).alias("comfortable"))


@query(
    "dd_bucket",
    """WITH {frames}, s AS (SELECT log, idx, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) OVER (PARTITION BY log ORDER BY idx ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) / 50 AS against FROM frames)
SELECT log, idx, CASE WHEN against < 2 THEN 1e0 WHEN against < 6 THEN 0.5e0 ELSE 0e0 END AS direction FROM s""",
)
def dd_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)
    against = sequence.rolling_sum(c, 10, sequence.along("log", "idx")) / 50
    return frames(spark, sf_dir).withColumn("against", against).select("log", "idx", classify.direction_score(F.col("against")).alias("direction"))


@query(
    "group_advantage",
    "SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 0.0001e0), 4) + 0e0 AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)",
)
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.group_advantage(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey").select("o_orderkey", (F.round("advantage", 4) + 0.0).alias("advantage"))


@query(
    "masked_mean",
    "SELECT l_returnflag, round(sum(l_quantity * CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 6) AS mean FROM lineitem GROUP BY 1",
)
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.when(F.col("l_discount") > 0.05, 1).otherwise(0)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(r6(scoring.masked_mean(F.col("l_quantity"), mask)).alias("mean"))


@query("first_infraction", "WITH {frames} SELECT log, CAST(coalesce(min(idx) FILTER (WHERE event_type = 'error'), 'infinity'::DOUBLE) AS DOUBLE) * 0.1e0 AS first_time FROM frames GROUP BY log HAVING min(idx) FILTER (WHERE event_type = 'error') IS NOT NULL")
def first_infraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.first_infraction(frames(spark, sf_dir), ["log"], F.col("event_type") == "error", "idx", 0.1)
    return out.where(F.col("first_time") < float("inf"))


_CONTACTS = """contacts AS (SELECT l_suppkey AS proposal, l_partkey % 50 AS object, l_orderkey * 10 + l_linenumber AS k, l_returnflag <> 'N' AS fault, l_linestatus FROM lineitem)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem")
    return own.select(
        F.col("l_suppkey").alias("proposal"), (F.col("l_partkey") % 50).alias("object"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), (F.col("l_returnflag") != "N").alias("fault"), "l_linestatus"
    )


@query(
    "fault_fold",
    f"""WITH {_CONTACTS}, f AS (SELECT *, min(CASE WHEN NOT fault THEN k END) OVER (PARTITION BY proposal, object) AS clean FROM contacts)
SELECT proposal, object, k FROM f WHERE fault AND (clean IS NULL OR k < clean)""",
)
def fault_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.counted_faults(_contacts(spark, sf_dir), ["proposal", "object"], "k", "fault").where("counts").select("proposal", "object", "k")


@query(
    "nc_score",
    f"""WITH {_CONTACTS}, f AS (SELECT *, min(CASE WHEN NOT fault THEN k END) OVER (PARTITION BY proposal, object) AS clean FROM contacts)
SELECT proposal, coalesce(min(CASE WHEN fault AND (clean IS NULL OR k < clean) THEN CASE WHEN l_linestatus = 'O' THEN 0e0 ELSE 0.5e0 END END), 1e0) AS nc FROM f GROUP BY proposal""",
)
def nc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.counted_faults(_contacts(spark, sf_dir), ["proposal", "object"], "k", "fault")
    penalty = F.when(F.col("counts"), F.when(F.col("l_linestatus") == "O", 0.0).otherwise(0.5))
    return found.groupBy("proposal").agg(F.coalesce(F.min(penalty), F.lit(1.0)).alias("nc"))


@query(
    "collision_class",
    """WITH {poses} SELECT token, CASE WHEN abs(y) <= 0.05e0 THEN 'stopped_ego' WHEN abs(heading) <= 0.05e0 THEN 'stopped_track' WHEN x - idx > 0.4e0 THEN 'active_rear' WHEN token % 2 = 0 THEN 'active_front' ELSE 'active_lateral' END AS class FROM poses""",
)
def collision_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classify.collision_class(F.abs("y"), F.abs("heading"), F.col("x") - F.col("idx") > 0.4, F.col("token") % 2 == 0)
    return poses(spark, sf_dir).select("token", c.alias("class"))


# ------------------------------------------------------------------ manoeuvre classes
_ENDS_SQL = """ends AS (SELECT log, idx // 14 AS chunk, min(value) FILTER (WHERE idx % 14 = 0) / 50 AS v0, min(value) FILTER (WHERE idx % 14 = 13) / 50 AS v1,
min(y * 8) FILTER (WHERE idx % 14 = 13) AS last_y, max(abs(y * 8)) AS widest, min(heading * 3) FILTER (WHERE idx % 14 = 13) AS last_x FROM poses GROUP BY ALL HAVING count(*) = 14)"""


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, c: F.min(F.when(F.col("idx") % 14 == k, c))
    return scenes.tumbling(
        poses(spark, sf_dir),
        14,
        [
            (at(0, F.col("value")) / 50).alias("v0"),
            (at(13, F.col("value")) / 50).alias("v1"),
            at(13, F.col("y") * 8).alias("last_y"),
            F.max(F.abs(F.col("y") * 8)).alias("widest"),
            at(13, F.col("heading") * 3).alias("last_x"),
        ],
    )


def _longitudinal_sql(stop: str, const: str) -> str:
    return f"""CASE WHEN v0 < {stop} AND v1 < {stop} THEN 'stop' WHEN v1 < {stop} THEN 'decelerate to stop' WHEN abs(v1 - v0) < {const} THEN 'keep speed'
WHEN v1 - v0 > 0 AND v1 > 2 * v0 THEN 'quick acceleration' WHEN v1 - v0 > 0 THEN 'acceleration' WHEN v0 > 2 * v1 THEN 'quick deceleration' ELSE 'deceleration' END"""


@query(
    "meta_action_a",
    f"""WITH {{poses}}, {_ENDS_SQL} SELECT log, chunk, {_longitudinal_sql("0.3e0", "0.8e0")} AS longitudinal,
CASE WHEN widest < 2 THEN 'go straight' WHEN widest < 4 THEN 'change lane to ' || CASE WHEN last_y > 0 THEN 'left' ELSE 'right' END ELSE 'turn ' || CASE WHEN last_y > 0 THEN 'left' ELSE 'right' END END AS lateral FROM ends""",
)
def meta_action_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(spark, sf_dir).select(
        "log", "chunk", classify.longitudinal_action(F.col("v0"), F.col("v1")).alias("longitudinal"), classify.lateral_action(F.col("last_y"), F.col("widest")).alias("lateral")
    )


@query(
    "meta_action_b",
    f"""WITH {{poses}}, {_ENDS_SQL} SELECT log, chunk, {_longitudinal_sql("0.5e0", "0.5e0")} AS longitudinal,
CASE WHEN abs(last_x) < 0.5e0 THEN 'go straight' WHEN abs(last_x) < 4 THEN 'change lane to ' || CASE WHEN last_x < 0 THEN 'left' ELSE 'right' END ELSE 'turn ' || CASE WHEN last_x < 0 THEN 'left' ELSE 'right' END END AS lateral FROM ends""",
)
def meta_action_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ends(spark, sf_dir).select(
        "log", "chunk", classify.longitudinal_action(F.col("v0"), F.col("v1"), 0.5, 0.5).alias("longitudinal"), classify.lateral_action_by_x(F.col("last_x")).alias("lateral")
    )


@query(
    "ego_quantise",
    """WITH {poses} SELECT token, CASE WHEN value / 40 < 0.3e0 THEN 'stopped' WHEN value / 40 < 3 THEN 'slow' WHEN value / 40 < 8 THEN 'moderate' ELSE 'fast' END AS speed,
CASE WHEN heading > 0.5e0 THEN 'accelerating' WHEN heading < -0.5e0 THEN 'decelerating' ELSE 'constant' END AS acceleration FROM poses""",
)
def ego_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("token", classify.speed_class(F.col("value") / 40).alias("speed"), classify.acceleration_class(F.col("heading")).alias("acceleration"))


@query("command_from_offset", "WITH {poses} SELECT token, CASE WHEN heading >= 2 THEN 'right' WHEN heading <= -2 THEN 'left' ELSE 'straight' END AS command FROM poses")
def command_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("token", classify.command_from_offset(F.col("heading")).alias("command"))


@query("command_decode", "SELECT event_id, ['LEFT', 'FORWARD', 'RIGHT', 'UNKNOWN'][event_id % 4 + 1] AS command FROM events")
def command_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("event_id") % 4 == i).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", classify.decode_command(hot).alias("command"))


@query("text_penalty", "SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN round(1 / (1 + exp(-(n_chars - 400) * 0.002e0)), 6) ELSE 0 END AS penalty FROM documents")
def text_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r6(classify.length_penalty(F.col("text"), F.col("n_chars"), "the")).alias("penalty"))


@query("route_class", "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'left') THEN 'left' WHEN contains(lower(text), 'right') THEN 'right' ELSE 'straight' END AS route FROM conversations")
def route_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.route_class(F.col("text")).alias("route"))


@query("target_speed", "SELECT o_orderkey, CAST(0.8e0 * coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) END, 15) AS DOUBLE) AS target FROM orders")
def target_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("double"))
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.target_speed(F.lit(0.8), limit).alias("target"))


# ------------------------------------------------------------------ spatial
@query(
    "nearest_k_per_type",
    """WITH {frames}, d AS (SELECT log, event_type, token, abs(value - 100) AS dist FROM frames)
SELECT log, event_type, token, rank FROM (SELECT *, row_number() OVER (PARTITION BY log, event_type ORDER BY dist, token) AS rank FROM d)
WHERE rank <= CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 3 ELSE 2 END""",
)
def nearest_k_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).withColumn("dist", F.abs(F.col("value") - 100))
    caps = F.when(F.col("event_type") == "click", 5).when(F.col("event_type") == "view", 3).otherwise(2)
    return scoring.nearest_k(own, ["log", "event_type"], "dist", "token", caps).select("log", "event_type", "token", F.col("rank").cast("long").alias("rank"))


@query(
    "lead_object",
    """WITH {frames} SELECT a.log, a.token, min({'v': b.value, 't': b.token}).t AS found, round(min(b.value - a.value), 6) AS gap FROM frames a JOIN frames b ON a.log = b.log AND b.value > a.value AND b.value <= a.value + 20
GROUP BY a.log, a.token""",
)
def lead_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).select("log", "token", "idx", "value")
    found = spatial.nearest_within(own.select("log", "token", "value"), own, "log", "value", 20.0, "token")
    return found.select("log", "token", "found", r6("gap").alias("gap"))


_BOX_SQL = """{poses}, ego AS (SELECT log, token, idx AS t, x, y, heading AS h, 4.5e0 / 2 AS l, 1e0 AS w FROM poses),
obj AS (SELECT log % 20 AS site, log, token, idx AS t, x, y, heading AS h, 2e0 / 2 AS l, 1e0 / 2 AS w FROM poses),
pairs AS (SELECT e.log % 20 AS site, e.log, e.token, e.t, o.token AS object, e.x AS ex, e.y AS ey, e.h AS eh, e.l AS el, e.w AS ew, o.x AS ox, o.y AS oy, o.h AS oh, o.l AS ol, o.w AS ow FROM ego e JOIN obj o ON e.log % 20 = o.site AND o.log <> e.log AND o.t = e.t + {shift}),
axes AS (SELECT *, unnest([eh, eh + pi() / 2, oh, oh + pi() / 2]) AS a FROM pairs),
sep AS (SELECT *, abs((ox - ex) * cos(a) + (oy - ey) * sin(a)) AS gap,
el * abs(cos(eh - a)) + ew * abs(sin(eh - a)) + ol * abs(cos(oh - a)) + ow * abs(sin(oh - a)) AS reach FROM axes)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = poses(spark, sf_dir).withColumn("site", F.col("log") % 20)
    ego = spatial.with_box(own, "a", 4.5, 2.0)
    objects = spatial.with_box(own, "b", 2.0, 1.0)
    cols = lambda p: [f"{p}{a}{i}" for i in range(4) for a in "xy"]
    return (
        ego.select("site", F.col("idx").alias("t0"), "log", "token", *cols("a")),
        objects.select("site", F.col("idx").alias("t"), F.col("log").alias("other"), F.col("token").alias("object"), *cols("b")),
    )


@query("box_intersect", f"WITH {_BOX_SQL.replace('{shift}', '0')} SELECT token, object FROM sep GROUP BY token, object HAVING bool_and(gap <= reach + 1e-9)")
def box_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ego, objects = _boxes(spark, sf_dir)
    return spatial.box_join(ego.withColumn("t", F.col("t0")), objects, ["site", "t"]).where("log <> other").select("token", "object")


@query("ttc_shift_join", f"WITH {_BOX_SQL.replace('{shift}', '3')} SELECT token, object, CAST(3 AS BIGINT) AS ahead FROM sep GROUP BY token, object HAVING bool_and(gap <= reach + 1e-9)")
def ttc_shift_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ego, objects = _boxes(spark, sf_dir)
    looked = spatial.time_shifted(ego, [3], "t0")
    return spatial.box_join(looked, objects, ["site", "t"]).where("log <> other").select("token", "object", "ahead")




def _ring(k: int) -> Column:
    pts = ((0.03, 0.02), (30.03, 0.02), (30.03, 0.33), (15.03, 0.13), (0.03, 0.33)) if k == 0 else ((10.03, -0.61), (60.03, -0.61), (60.03, 0.053), (35.03, -0.21), (10.03, 0.053))
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pts])


@query(
    "pip_join",
    """WITH {poses}, v(polygon_id, k, x, y) AS (VALUES (0, 0, 0.03e0, 0.02e0), (0, 1, 30.03e0, 0.02e0), (0, 2, 30.03e0, 0.33e0), (0, 3, 15.03e0, 0.13e0), (0, 4, 0.03e0, 0.33e0),
(1, 0, 10.03e0, -0.61e0), (1, 1, 60.03e0, -0.61e0), (1, 2, 60.03e0, 0.053e0), (1, 3, 35.03e0, -0.21e0), (1, 4, 10.03e0, 0.053e0)),
e AS (SELECT a.polygon_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM v a JOIN v b ON a.polygon_id = b.polygon_id AND b.k = (a.k + 1) % 5),
c AS (SELECT p.token, e.polygon_id, count(*) FILTER (WHERE (ay > p.y) <> (b_y > p.y) AND p.x < (bx - ax) * (p.y - ay) / nullif(b_y - ay, 0) + ax) AS n FROM poses p, e GROUP BY ALL)
SELECT token, polygon_id FROM c WHERE n % 2 = 1""",
)
def pip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = spark.range(2).select(F.col("id").cast("int").alias("polygon_id"), F.when(F.col("id") == 0, _ring(0)).otherwise(_ring(1)).alias("ring"))
    points = poses(spark, sf_dir).select("token", F.col("x").alias("px"), F.col("y").alias("py"))
    return spatial.point_in_polygon(points, polygons).select("token", "polygon_id")


@query(
    "project_progress",
    """WITH {poses}, p AS (SELECT log, idx, x, y FROM poses), st AS (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY log ORDER BY idx)),
c AS (SELECT log, idx, x, y, sum(step) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM st),
seg AS (SELECT log, s AS t0, x AS x0, y AS y0, lead(s) OVER w AS t1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c WINDOW w AS (PARTITION BY log ORDER BY s) QUALIFY t1 IS NOT NULL),
q AS (SELECT log, idx, y + 6 AS px, heading AS py FROM poses WHERE idx IN (0, 10)),
j AS (SELECT q.log, q.idx, px, py, seg.*, least(greatest(coalesce(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0), 0), 0), 1) AS t FROM q JOIN seg ON q.log = seg.log),
d AS (SELECT log, idx, t0 + t * (t1 - t0) AS s, sqrt(power(px - (x0 + t * (x1 - x0)), 2) + power(py - (y0 + t * (y1 - y0)), 2)) AS d, t0 FROM j),
r AS (SELECT log, idx, s FROM d QUALIFY row_number() OVER (PARTITION BY log, idx ORDER BY round(d, 9), t0) = 1)
SELECT a.log, round(greatest(b.s - a.s, 0), 5) AS progress FROM r a JOIN r b ON a.log = b.log AND a.idx = 0 AND b.idx = 10""",
)
def project_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    path = poses(spark, sf_dir).withColumn("step", sequence.step_length(F.col("x"), F.col("y"), w)).withColumn("s", sequence.cumulative(F.col("step"), w))
    segments = sequence.intervals(path, "s", ["x", "y"], "log").where("t1 IS NOT NULL")
    points = poses(spark, sf_dir).where("idx IN (0, 10)").select("log", "idx", (F.col("y") + 6).alias("px"), F.col("heading").alias("py"))
    found = spatial.nearest_segment(points, segments, "log")
    ends = found.groupBy("log").agg(F.max(F.when(F.col("idx") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("idx") == 10, F.col("s"))).alias("b"))
    return ends.where("a IS NOT NULL AND b IS NOT NULL").select("log", (F.round(F.greatest(F.col("b") - F.col("a"), F.lit(0.0)), 5) + 0.0).alias("progress"))


@query(
    "hist2d",
    """WITH p AS (SELECT CASE WHEN p_size = 50 THEN 9 ELSE floor((p_size - 0e0) / (50e0 / 10)) END AS bx, CASE WHEN p_retailprice = 2100 THEN 9 ELSE floor((p_retailprice - 900) / (1200e0 / 10)) END AS bin_y FROM part WHERE p_size BETWEEN 0 AND 50 AND p_retailprice BETWEEN 900 AND 2100)
SELECT CAST(bx AS BIGINT) AS bx, CAST(bin_y AS BIGINT) AS bin_y, least(count(*), 5) / 5e0 AS share FROM p GROUP BY ALL""",
)
def hist2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.histogram_2d(table(spark, sf_dir, "part"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), (0.0, 50.0), (900.0, 2100.0), 10, 5)


@query(
    "proposal_grid",
    "SELECT a.r_regionkey AS lateral, b.n_nationkey AS longitudinal, a.r_regionkey * 25 + b.n_nationkey AS idx FROM region a, nation b",
)
def proposal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lateral = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("lateral"))
    inner = table(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_nationkey")).alias("all"))  # 25 nations, whatever the scale
    return lateral.join(inner).select("lateral", F.explode("all").alias("longitudinal")).select("*", (F.col("lateral") * 25 + F.col("longitudinal")).alias("idx"))


@query("failure_rows", "SELECT o_orderkey, o_orderstatus <> 'P' AS valid, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000, 6) END AS metric FROM orders")
def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.col("o_orderstatus") != "P"
    return table(spark, sf_dir, "orders").select("o_orderkey", good.alias("valid"), F.when(good, r6(F.col("o_totalprice") / 1000)).alias("metric"))




@query(
    "score_report",
    f"""WITH {{frames}}, {_SCORES_SQL} SELECT log % 4 AS site, log, CAST(grouping(log % 4) + grouping(log) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE valid) AS n_valid,
round(avg(progress) FILTER (WHERE valid), 6) + 0e0 AS progress, round(avg(score) FILTER (WHERE valid), 6) + 0e0 AS score FROM scored GROUP BY ROLLUP (log % 4, log)""",
)
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, successes and means by log, by site and over all, from one reading of the scores."""
    rows = scores(spark, sf_dir).withColumn("site", F.col("log") % 4)
    return scoring.report(rows, ["site", "log"], ["progress", "score"]).select("site", "log", "level", "n", "n_valid", r6("progress").alias("progress"), r6("score").alias("score"))
