"""Scene extraction, token sets and sequence operators, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.operators import scenes, sequence
from kerbline.registry import frames, poses, query, r6, table

N = 14


def _windows_sql(step: int) -> str:
    return f"""WITH {{frames}}, w AS (
SELECT log, idx, token, count(*) OVER a AS n, lead(token, 3) OVER o AS current_token, min(token) OVER a AS low, max(token) OVER a AS high, sum(value) OVER a AS total
FROM frames WINDOW a AS (PARTITION BY log ORDER BY idx ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING), o AS (PARTITION BY log ORDER BY idx))
SELECT log, idx AS start, current_token AS token, low, high, round(total, 6) AS total FROM w WHERE n = {N} AND idx % {step} = 0"""


def _windows(step: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = scenes.frame_windows(frames(spark, sf_dir), N, step, current=3, keep=("token", "value"))
        total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
        return w.select("log", "start", "token", F.array_min("tokens").alias("low"), F.array_max("tokens").alias("high"), F.round(total, 6).alias("total"))

    return run


for _step, _name in ((N, "tumbling"), (1, "hop1"), (4, "hop4")):
    query(f"scene_windows_{_name}", _windows_sql(_step))(_windows(_step))


_CHUNKS_SQL = f"""chunks AS (SELECT log, idx // {N} AS chunk, max(token) FILTER (WHERE idx % {N} = 3) AS token,
count(*) FILTER (WHERE event_type = 'purchase') AS route, count(*) AS n FROM frames GROUP BY ALL HAVING count(*) = {N})"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.tumbling(
        frames(spark, sf_dir), N, [F.max(F.when(F.col("idx") % N == 3, F.col("token"))).alias("token"), F.count_if(F.col("event_type") == "purchase").alias("route")]
    )


@query("scene_filter_logs", f"WITH {{frames}}, {_CHUNKS_SQL} SELECT log, chunk, token FROM chunks WHERE log % 3 = 0")
def scene_filter_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = frames(spark, sf_dir).where("log % 3 = 0")  # before the windows, so it reaches the scan
    return scenes.tumbling(kept, N, [F.max(F.when(F.col("idx") % N == 3, F.col("token"))).alias("token")]).select("log", "chunk", "token")


@query("scene_filter_tokens", f"WITH {{frames}}, {_CHUNKS_SQL} SELECT log, chunk, token FROM chunks WHERE token IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def scene_filter_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("token"))
    return scenes.with_tokens(_chunks(spark, sf_dir), wanted).select("log", "chunk", "token")


@query("scene_filter_route", f"WITH {{frames}}, {_CHUNKS_SQL} SELECT log, chunk, token, route FROM chunks WHERE route > 0")
def scene_filter_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).where("route > 0").select("log", "chunk", "token", "route")


@query("scene_filter_max", f"WITH {{frames}}, {_CHUNKS_SQL} SELECT log, chunk, token FROM chunks ORDER BY log, chunk LIMIT 25")
def scene_filter_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.first_scenes(_chunks(spark, sf_dir).select("log", "chunk", "token"), 25, ["log", "chunk"])


@query(
    "scene_dedup_last",
    "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) = 1",
)
def scene_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.keep_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(
    "tokens_by_log",
    "WITH {frames} SELECT log, count(*) AS n, list_sort(list(token))[1] AS first_token, list_sort(list(token))[-1] AS last_token FROM frames GROUP BY log",
)
def tokens_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = scenes.tokens_by_log(frames(spark, sf_dir))
    return by.select("log", F.size("tokens").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first_token"), F.element_at("tokens", -1).alias("last_token"))


@query("log_counts", "SELECT o_custkey AS log, count(*) FILTER (WHERE o_orderstatus <> 'P') AS succeeded, count(*) - count(*) FILTER (WHERE o_orderstatus <> 'P') AS failed FROM orders GROUP BY 1")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.count_if(F.col("o_orderstatus") != "P")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("log")).agg(good.alias("succeeded"), (F.count("*") - good).alias("failed"))


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("token"))
    active = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("token"))
    return active, rich


_SETS = "a AS (SELECT DISTINCT o_custkey AS token FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT c_custkey AS token FROM customer WHERE c_acctbal > 5000)"


@query("token_intersect", f"WITH {_SETS} SELECT token FROM a INTERSECT SELECT token FROM b")
def token_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return a.intersect(b)


@query("except_missing", f"WITH {_SETS} SELECT token FROM a EXCEPT SELECT token FROM b")
def except_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return scenes.without_tokens(a.distinct(), b)


@query("except_unused", f"WITH {_SETS} SELECT token FROM b EXCEPT SELECT token FROM a")
def except_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_sets(spark, sf_dir)
    return scenes.without_tokens(b.distinct(), a)


@query(
    "set_equal",
    f"""WITH {_SETS}, j AS (SELECT a.token AS l, b.token AS r FROM a FULL JOIN b USING (token)), c AS (
SELECT count(*) FILTER (WHERE r IS NULL) AS missing, count(*) FILTER (WHERE l IS NULL) AS unused, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS shared FROM j)
SELECT *, missing = 0 AND unused = 0 AS equal FROM c""",
)
def set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.set_difference_counts(*_two_sets(spark, sf_dir), "token")


@query("token_join", "SELECT c_custkey AS token, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000 GROUP BY 1")
def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rich = _two_sets(spark, sf_dir)
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("token")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.join(rich, "token")


@query("resume_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return scenes.without_tokens(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("cache_complete", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 4")
def cache_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.complete_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 4)


@query(
    "part_split",
    "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, rn, least((rn - 1) // (n // 7), 6) AS part FROM r",
)
def part_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.equal_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 7, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "rn", "part")


@query("array_constraint", "SELECT label, count(*) AS n, bool_and(len(embedding) = 64) AS agree FROM embeddings GROUP BY label")
def array_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = scenes.array_lengths_agree(table(spark, sf_dir, "embeddings").withColumn("other", F.array_repeat(F.lit(0.0), 64)), ["embedding", "other"])
    own = table(spark, sf_dir, "embeddings").withColumn("other", F.array_repeat(F.lit(0.0), 64))
    return own.groupBy("label").agg(F.count("*").alias("n"), F.bool_and(same).alias("agree"))


@query(
    "offset_self_join",
    "WITH {frames} SELECT a.log, a.idx, a.token, b.token AS token_35, c.token AS token_50 FROM frames a JOIN frames b ON a.log = b.log AND b.idx = a.idx + 35 JOIN frames c ON a.log = c.log AND c.idx = a.idx + 50",
)
def offset_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.offset_join(frames(spark, sf_dir), [35, 50])


@query(
    "frame_sequence_complete",
    """WITH {frames}, calm AS (SELECT * FROM frames WHERE event_type <> 'error')
SELECT s.log, s.idx, s.token FROM calm s WHERE (SELECT count(*) FROM calm h WHERE h.log = s.log AND h.idx IN (s.idx, s.idx - 2, s.idx - 4, s.idx - 6)) = 4""",
)
def frame_sequence_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.sequence_complete(frames(spark, sf_dir).where("event_type <> 'error'"), 4, 2).select("log", "idx", "token")


@query("history_future", "WITH {frames} SELECT log, idx, token, lag(token, 3) OVER w AS oldest, lead(token, 4) OVER w AS furthest FROM frames WINDOW w AS (PARTITION BY log ORDER BY idx) QUALIFY oldest IS NOT NULL AND furthest IS NOT NULL")
def history_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    own = frames(spark, sf_dir).select("log", "idx", "token", F.lag("token", 3).over(w).alias("oldest"), F.lead("token", 4).over(w).alias("furthest"))
    return own.where("oldest IS NOT NULL AND furthest IS NOT NULL")


# ------------------------------------------------------------------ sequences
@query("stride_subsample", "WITH {frames} SELECT log, idx, token FROM frames WHERE idx >= 1 AND (idx - 1) % 5 = 0")
def stride_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.stride(frames(spark, sf_dir), 1, 5).select("log", "idx", "token")


@query(
    "velocity_diff",
    """WITH {poses}, d AS (SELECT log, idx, (lead(x) OVER w - x) / 0.5e0 AS dx, (lead(y) OVER w - y) / 0.5e0 AS dy FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round(coalesce(dx, lag(dx) OVER w, 0), 6) AS v_x, round(coalesce(dy, lag(dy) OVER w, 0), 6) + 0e0 AS v_y FROM d WINDOW w AS (PARTITION BY log ORDER BY idx)""",
)
def velocity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sequence.forward_velocity(poses(spark, sf_dir), ["x", "y"], 0.5, "log", "idx")
    return v.select("log", "idx", r6("v_x").alias("v_x"), r6("v_y").alias("v_y"))


@query(
    "accel_diff",
    """WITH {poses}, s AS (SELECT log, idx, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) / 0.5e0 AS speed FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round(speed, 6) AS speed, round((speed - lag(speed) OVER w) / 0.5e0, 6) + 0e0 AS acceleration FROM s WINDOW w AS (PARTITION BY log ORDER BY idx)""",
)
def accel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sequence.speed_and_acceleration(poses(spark, sf_dir), 0.5, "log", "idx")
    return v.select("log", "idx", r6("speed").alias("speed"), r6("acceleration").alias("acceleration"))


@query("heading_disp", "WITH {poses} SELECT log, idx, round(atan2(y - lag(y, 1, 0e0) OVER w, x - lag(x, 1, 0e0) OVER w + 0.0001e0), 6) + 0e0 AS heading_d FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx)")
def heading_disp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.heading_from_displacement(poses(spark, sf_dir), "log", "idx", 1e-4).select("log", "idx", r6("heading_d").alias("heading_d"))


@query(
    "static_gap_fill",
    """WITH {poses}, s AS (SELECT log, idx, heading, abs(y - lag(y, 1, 0e0) OVER w) AS step FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx)),
m AS (SELECT *, CASE WHEN step >= 0.25e0 THEN heading END AS seen FROM s)
SELECT log, idx, round(coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING),
first_value(seen IGNORE NULLS) OVER (PARTITION BY log ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) + 0e0 AS filled FROM m""",
)
def static_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    own = poses(spark, sf_dir).withColumn("step", F.abs(F.col("y") - F.lag("y", 1, 0.0).over(w)))
    return sequence.fill_static(own, "heading", F.col("step") >= 0.25, "log", "idx").select("log", "idx", r6("filled").alias("filled"))


@query(
    "pad_forward_mask",
    """WITH {frames} SELECT log, idx, coalesce(lead(token, 1) OVER w, last_value(token) OVER a) AS f1, coalesce(lead(token, 2) OVER w, last_value(token) OVER a) AS f2,
CAST(lead(token, 1) OVER w IS NOT NULL AS INTEGER) AS m1, CAST(lead(token, 2) OVER w IS NOT NULL AS INTEGER) AS m2
FROM frames WINDOW w AS (PARTITION BY log ORDER BY idx), a AS (PARTITION BY log ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def pad_forward_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pad_forward(frames(spark, sf_dir), "token", 2, "log", "idx").select("log", "idx", "f1", "f2", "m1", "m2")


@query("pad_back_extrapolate", "WITH {poses} SELECT log, idx, round(coalesce(lag(x) OVER w, x - coalesce(lead(x) OVER w - x, 0)), 6) AS before FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx)")
def pad_back_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.extrapolate_back(poses(spark, sf_dir), "x", "log", "idx").select("log", "idx", r6("before").alias("before"))


@query(
    "phase_unwrap",
    """WITH {poses}, t AS (SELECT log, idx, heading, coalesce(round_even((heading - lag(heading) OVER w) / (2 * pi()), 0), 0) AS turns FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round(heading - 2 * pi() * sum(turns) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) + 0e0 AS unwrapped FROM t""",
)
def phase_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.phase_unwrap(poses(spark, sf_dir), "heading", "log", "idx").select("log", "idx", r6("unwrapped").alias("unwrapped"))


@query(
    "rolling_direction",
    "WITH {frames} SELECT log, idx, round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) OVER (PARTITION BY log ORDER BY idx ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS against FROM frames",
)
def rolling_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)
    return frames(spark, sf_dir).select("log", "idx", r6(sequence.rolling_sum(c, 10, sequence.along("log", "idx"))).alias("against"))


@query(
    "arc_length",
    """WITH {poses}, s AS (SELECT log, idx, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round(sum(step) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS s FROM s""",
)
def arc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    own = poses(spark, sf_dir).withColumn("step", sequence.step_length(F.col("x"), F.col("y"), w))
    return own.select("log", "idx", r6(sequence.cumulative(F.col("step"), w)).alias("s"))


@query(
    "interp_tracks",
    """WITH {frames}, e AS (SELECT log, epoch_us(ts) // 1000000 AS t, avg(value) AS v FROM frames GROUP BY ALL), p AS (
SELECT log, t AS t0, v AS v0, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM e WINDOW w AS (PARTITION BY log ORDER BY t)),
g AS (SELECT log, t0, v0, t1, v1, unnest(range(CAST(ceil(t0 / 86400e0) AS BIGINT), CAST(CASE WHEN t1 IS NULL THEN floor(t0 / 86400e0) + 1 ELSE ceil(t1 / 86400e0) END AS BIGINT))) AS k FROM p)
SELECT log, k * 86400 AS t, round(v0 + CASE WHEN t1 IS NULL THEN 0 ELSE (k * 86400 - t0) / CAST(t1 - t0 AS DOUBLE) END * (coalesce(v1, v0) - v0), 6) AS v FROM g""",
)
def interp_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    own = frames(spark, sf_dir).groupBy("log", seconds.alias("t")).agg(F.avg("value").alias("v"))
    return sequence.interpolate(own, "t", ["v"], "log", 86400).select("log", "t", r6("v").alias("v"))


@query(
    "resample_linear",
    """WITH {poses}, p AS (SELECT log, idx + 1 AS k, x, y FROM poses UNION ALL SELECT DISTINCT log, 0, 0e0, 0e0 FROM poses),
b AS (SELECT *, coalesce(lead(x) OVER w, x) AS nx, coalesce(lead(y) OVER w, y) AS ny, max(k) OVER (PARTITION BY log) AS last FROM p WINDOW w AS (PARTITION BY log ORDER BY k)),
g AS (SELECT unnest(range(1, 41)) AS step), j AS (SELECT b.*, g.step FROM b JOIN g ON b.k = least(step // 5, last))
SELECT log, step, round(x + least(step / 5e0 - k, 1e0) * (nx - x), 6) AS x, round(y + least(step / 5e0 - k, 1e0) * (ny - y), 6) + 0e0 AS y FROM j""",
)
def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).select("log", "idx", "x", "y")
    return sequence.resample_clamped(own, "idx", ["x", "y"], "log", 0.5, 4.0, 0.1).select("log", "step", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "sliding_reward",
    """WITH r AS (SELECT o_custkey, o_orderkey, avg(o_totalprice) OVER w AS m, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT o_custkey, o_orderkey, round(m, 4) AS mean FROM r WHERE n = 5""",
)
def sliding_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sequence.sliding_mean(table(spark, sf_dir, "orders"), "o_totalprice", 5, "o_custkey", ["o_orderdate", "o_orderkey"])
    return own.where("mean IS NOT NULL").select("o_custkey", "o_orderkey", F.round("mean", 4).alias("mean"))


@query("lead_refresh", "WITH {frames} SELECT log, idx, last_value(CASE WHEN idx % 2 = 0 THEN token END IGNORE NULLS) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING) AS held FROM frames")
def lead_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.refresh_every(frames(spark, sf_dir), "token", 2, "log", "idx").select("log", "idx", "held")


@query(
    "path_interpolate",
    """WITH {poses}, p AS (SELECT * FROM poses), st AS (SELECT log, idx, x, y, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY log ORDER BY idx)),
c AS (SELECT log, idx, x, y, sum(step) OVER (PARTITION BY log ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM st),
b AS (SELECT *, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(s) OVER (PARTITION BY log) AS top FROM c WINDOW w AS (PARTITION BY log ORDER BY s)),
d AS (SELECT unnest([0.00001e0, 2.5e0, 7e0, 1000e0]) AS d)
SELECT log, d, round(x + coalesce((least(d, top) - s) / nullif(s1 - s, 0), 0) * (x1 - x), 6) AS x, round(y + coalesce((least(d, top) - s) / nullif(s1 - s, 0), 0) * (y1 - y), 6) + 0e0 AS y
FROM b, d WHERE s1 IS NOT NULL AND least(d, top) >= s AND (least(d, top) < s1 OR (least(d, top) = top AND s1 = top))""",
)
def path_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    own = poses(spark, sf_dir).withColumn("step", sequence.step_length(F.col("x"), F.col("y"), w)).withColumn("s", sequence.cumulative(F.col("step"), w))
    asked = own.select("log").distinct().select("log", F.explode(F.array(*[F.lit(v) for v in (1e-5, 2.5, 7.0, 1000.0)])).alias("d"))
    return sequence.path_at(own, asked, "log", ["x", "y"]).select("log", "d", r6("x").alias("x"), r6("y").alias("y"))


# ------------------------------------------------------------------ geometry
@query(
    "se2_relative",
    """WITH {poses}, o AS (SELECT *, first_value(x) OVER w AS ox, first_value(y) OVER w AS oy, first_value(heading) OVER w AS oh FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT log, idx, round((x - ox) * cos(oh) + (y - oy) * sin(oh), 6) + 0e0 AS lx, round((y - oy) * cos(oh) - (x - ox) * sin(oh), 6) + 0e0 AS ly, round(atan2(sin(heading - oh), cos(heading - oh)), 6) + 0e0 AS lh FROM o""",
)
def se2_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = sequence.along("log", "idx")
    own = poses(spark, sf_dir).select("*", *[F.first(c).over(w).alias(o) for c, o in (("x", "ox"), ("y", "oy"), ("heading", "oh"))])
    local = geo.to_local(*[F.col(c) for c in ("x", "y", "heading", "ox", "oy", "oh")])
    return own.select("log", "idx", *[r6(c).alias(n) for c, n in zip(local, ("lx", "ly", "lh"), strict=True)])


@query("wrap_angle", "WITH {poses}, a AS (SELECT log, idx, heading * 3 + pi() AS b FROM poses) SELECT log, idx, round(b - 2 * pi() * floor(b / (2 * pi())) - pi(), 6) + 0e0 AS wrapped FROM a")
def wrap_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("log", "idx", r6(geo.wrap_angle(F.col("heading") * 3)).alias("wrapped"))


@query("normalize_angle", "WITH {poses} SELECT log, idx, round(atan2(sin(heading * 3), cos(heading * 3)), 6) + 0e0 AS normal FROM poses")
def normalize_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).select("log", "idx", r6(geo.normalize_angle(F.col("heading") * 3)).alias("normal"))


@query(
    "box_corners",
    """WITH {poses} SELECT token, round(x + 2.25e0 * cos(heading) - 1e0 * sin(heading), 6) + 0e0 AS lf_x, round(y + 2.25e0 * sin(heading) + 1e0 * cos(heading), 6) + 0e0 AS lf_y,
round(x - 2.25e0 * cos(heading) + 1e0 * sin(heading), 6) + 0e0 AS rb_x, round(y - 2.25e0 * sin(heading) - 1e0 * cos(heading), 6) + 0e0 AS rb_y FROM poses""",
)
def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geo.box_corners(F.col("x"), F.col("y"), F.col("heading"), 4.5, 2.0)
    return poses(spark, sf_dir).select("token", r6(c[0][0]).alias("lf_x"), r6(c[0][1]).alias("lf_y"), r6(c[2][0]).alias("rb_x"), r6(c[2][1]).alias("rb_y"))


@query("parallel_path", "WITH {poses} SELECT log, idx, round(x - 1.5e0 * sin(heading), 6) + 0e0 AS px, round(y + 1.5e0 * cos(heading), 6) + 0e0 AS py FROM poses")
def parallel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = geo.parallel_offset(F.col("x"), F.col("y"), F.col("heading"), 1.5)
    return poses(spark, sf_dir).select("log", "idx", r6(px).alias("px"), r6(py).alias("py"))


@query(
    "quaternion_yaw",
    "WITH {poses} SELECT token, round(atan2(2 * (cos(heading / 2) * sin(heading / 2)), 1 - 2 * (sin(heading / 2) * sin(heading / 2))), 6) + 0e0 AS yaw FROM poses",
)
def quaternion_yaw(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("heading") / 2
    return poses(spark, sf_dir).select("token", r6(geo.quaternion_yaw(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))).alias("yaw"))


@query(
    "pinhole_fov",
    """WITH {poses}, p AS (SELECT token, y * 3 AS cx, heading AS cy, x - 5 AS cz FROM poses), u AS (SELECT token, cz, CASE WHEN cz > 0 THEN 500 * cx / cz + 320 END AS u, CASE WHEN cz > 0 THEN 500 * cy / cz + 240 END AS v FROM p)
SELECT token, round(u, 6) AS u, round(v, 6) AS v, coalesce(cz > 0.001e0 AND u > 0 AND u < 639 AND v > 0 AND v < 479, false) AS visible FROM u""",
)
def pinhole_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).select("token", (F.col("y") * 3).alias("cx"), F.col("heading").alias("cy"), (F.col("x") - 5).alias("cz"))
    u, v = geo.project_pinhole(F.col("cx"), F.col("cy"), F.col("cz"), 500.0, 320.0, 240.0)
    own = own.withColumn("u", u).withColumn("v", v)
    return own.select("token", r6("u").alias("u"), r6("v").alias("v"), geo.in_view(F.col("u"), F.col("v"), F.col("cz"), 640, 480).alias("visible"))


@query(
    "constant_velocity",
    "WITH {poses} SELECT token, k AS step, round((k * 0.5e0) * sqrt(y * y + heading * heading), 6) AS ahead FROM poses, range(1, 9) r(k) WHERE idx = 3",
)
def constant_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).where("idx = 3").select("token", F.hypot("y", "heading").alias("speed"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))).alias("step"))
    return own.select("token", "step", r6(F.col("step") * 0.5 * F.col("speed")).alias("ahead"))


@query(
    "first_sighting",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS r FROM events) WHERE r = 1 GROUP BY ALL",
)
def first_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("min_max_normalise", "SELECT event_id, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS share FROM events WINDOW w AS (PARTITION BY event_type)")
def min_max_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ends = events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row per type, so the join is a broadcast
    return events.join(ends, "event_type").select("event_id", r6(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("share"))


@query("running_unique_tokens", "SELECT DISTINCT o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS first_order, o_orderpriority FROM orders")
def running_unique_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("first_order")).select("o_custkey", "first_order", "o_orderpriority")


