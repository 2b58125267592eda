"""Filters, lane joins and the remaining sequence operators, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions import draws, geometry as geo
from kerbline.operators import filters, polygons, sequence, spatial
from kerbline.plans.score_queries import _ring
from kerbline.registry import frames, poses, query, r6, table


@query(
    "object_filter",
    """WITH {poses} SELECT p.token FROM poses p JOIN (SELECT log, x AS ex, y AS ey FROM poses WHERE idx = 0) e ON p.log = e.log WHERE p.event_type <> 'signup' AND sqrt(power(p.x - ex, 2) + power(p.y - ey, 2)) <= 20
AND NOT EXISTS (SELECT 1 FROM poses c WHERE c.log = p.log AND c.token = p.token AND c.event_type = 'error')""",
)
def object_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir)
    objects = own.select("log", F.col("token").alias("track_token"), F.when(F.col("event_type") == "signup", "ego").otherwise("vehicle").alias("name"), "x", "y")
    ego = own.where("idx = 0").select("log", F.col("x").alias("ego_x"), F.col("y").alias("ego_y"))
    collided = own.where("event_type = 'error'").select("log", F.col("token").alias("track_token"))
    return filters.nearby_objects(objects, ego, 20.0, collided, "log").select(F.col("track_token").alias("token"))


@query("red_lights", "SELECT o_orderkey AS token, 'red_light_' || o_custkey AS track_token FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def red_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lights = table(spark, sf_dir, "orders").select(F.lit(1).alias("g"), F.col("o_orderkey"), F.col("o_custkey").alias("lane_connector_id"), (F.col("o_orderstatus") == "F").alias("is_red"))
    lanes = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit(1).alias("g"), F.col("c_custkey").alias("lane_id"))
    return filters.red_lights_on_route(lights, lanes, "g").select(F.col("o_orderkey").alias("token"), "track_token")


@query("lidar_box", "WITH {poses} SELECT token, CASE WHEN heading >= 3 THEN NULL WHEN heading > 0.2e0 THEN 'above' ELSE 'below' END AS layer FROM poses WHERE x > 2 AND x < 30 AND y > -0.4e0 AND y < 0.4e0")
def lidar_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = poses(spark, sf_dir).where(filters.inside_box({"x": (2.0, 30.0), "y": (-0.4, 0.4)}))
    return kept.select("token", filters.height_layer(F.col("heading"), 0.2, 3.0).alias("layer"))


@query(
    "valid_samples",
    "WITH {frames}, c AS (SELECT *, count(*) OVER (PARTITION BY log) - idx - 1 AS after FROM frames) SELECT log, idx FROM c WHERE idx >= 3 AND (log % 2 = 1 OR after >= 10)",
)
def valid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.valid_samples(frames(spark, sf_dir), "log", "idx", 10, 3, F.col("log") % 2 == 0).select("log", "idx")


@query("preference_filter", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 2 > 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM orders")
def preference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(F.when(F.col("o_orderkey") % 3 > 0, 1).otherwise(-1), F.when(F.col("o_custkey") % 2 > 0, 0).otherwise(-1))
    own = table(spark, sf_dir, "orders").select("o_orderkey", scores.alias("s"), F.array("o_orderkey", "o_custkey").alias("i"))
    return own.select("o_orderkey", F.size(filters.liked(F.col("s"), F.col("i"))).alias("n"))


@query("camera_rename", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'front_left' WHEN o_custkey % 2 = 0 THEN 'left' ELSE 'front' END AS camera FROM orders")
def camera_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = F.when(F.col("o_orderstatus") == "F", "nuplan").otherwise("waymo")
    camera = F.when(F.col("o_custkey") % 2 == 0, "left").otherwise("front")
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.camera_name(dataset, camera).alias("camera"))


@query("split_logs", "WITH {frames} SELECT log, count(*) AS n FROM frames WHERE log IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND log % 5 <> 0 GROUP BY log")
def split_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("log"))
    wanted = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("log"))
    return filters.split_logs(frames(spark, sf_dir), split, wanted).groupBy("log").agg(F.count("*").alias("n"))


@query("box_visible", "SELECT DISTINCT l_orderkey AS box FROM lineitem WHERE l_discount > 0.08")
def box_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.visible_boxes(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "box"), "box", F.col("l_discount") > 0.08)


@query(
    "padded_nearest",
    """WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_totalprice) AS k FROM orders)
SELECT o_custkey, round(sum(o_totalprice), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM r WHERE k <= 4 GROUP BY o_custkey""",
)
def padded_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = filters.padded_nearest(table(spark, sf_dir, "orders").withColumn("d", F.col("o_totalprice")), "o_custkey", "d", "o_totalprice", 4)
    add = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return got.select("o_custkey", F.round(add("values", F.lit(0.0)), 2).alias("total"), add("mask", F.lit(0)).cast("long").alias("n"))


@query(
    "sampled_top_k",
    f"""WITH top AS (SELECT o_custkey, o_orderkey, -(o_totalprice / 100000) / 0.5e0 + {draws.gumbel_sql(["o_custkey", "o_orderkey"], 1)} AS g FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 100000, o_orderkey) <= 5)
SELECT o_custkey, o_orderkey FROM top QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY g DESC, o_orderkey DESC) = 1""",
)
def sampled_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.sampled_top_k(table(spark, sf_dir, "orders").withColumn("d", F.col("o_totalprice") / 100000), "o_custkey", "d", "o_orderkey", 5, 0.5, 1)


@query("random_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.random_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 3)


@query("stride_history", "WITH {frames} SELECT log, idx, idx - 6 AS first_index, CAST(3 AS INTEGER) AS n FROM frames WHERE idx >= 6")
def stride_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).where("idx >= 6").withColumn("h", sequence.history_indices(F.col("idx"), 7, 3))
    return own.select("log", "idx", F.get("h", F.lit(0)).alias("first_index"), F.size("h").alias("n"))


@query(
    "clamped_profile",
    "WITH {poses}, l AS (SELECT log, max(idx) AS last FROM poses WHERE idx < 20 GROUP BY log) SELECT f.log, f.idx, p.heading FROM poses f JOIN l ON f.log = l.log JOIN poses p ON p.log = f.log AND p.idx = least(f.idx, l.last)",
)
def clamped_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir)
    return sequence.clamped_profile(own.where("idx < 20").select("log", "idx", "heading"), own.select("log", "idx"), "log", "idx", ["heading"])


@query(
    "repair_jumps",
    """WITH RECURSIVE {poses}, s AS (SELECT log, list(heading ORDER BY idx) AS h FROM poses GROUP BY log),
r AS (SELECT log, h, 1 AS k, h[1] AS cur, h[1] AS total FROM s UNION ALL SELECT log, h, k + 1, CASE WHEN abs(h[k + 1] - cur) > 1.5e0 THEN cur ELSE h[k + 1] END, total + CASE WHEN abs(h[k + 1] - cur) > 1.5e0 THEN cur ELSE h[k + 1] END FROM r WHERE k < len(h))
SELECT log, round(cur, 6) + 0e0 AS last, round(total, 5) + 0e0 AS total FROM r WHERE k = len(h)""",
)
def repair_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).groupBy("log").agg(F.sort_array(F.collect_list(F.struct("idx", "heading"))).alias("s"))
    own = own.withColumn("h", F.transform("s", lambda q: q.heading)).withColumn("v", F.transform("s", lambda q: F.lit(True)))
    own = own.withColumn("r", sequence.repair_jumps(F.col("h"), F.col("v")))
    return own.select("log", r6(F.element_at("r", -1)).alias("last"), (F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"))


@query("path_between", "WITH {poses} SELECT log, count(*) AS n, min(idx) AS first_index FROM poses WHERE idx BETWEEN 3 AND 9 GROUP BY log HAVING count(*) > 1")
def path_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).select("log", F.col("idx").cast("double").alias("s"), "x")
    return sequence.path_between(own, "log", F.lit(3.0), F.lit(9.0), ["x"]).groupBy("log").agg(F.count("*").alias("n"), F.min("s").cast("long").alias("first_index"))


@query(
    "scoring_grid",
    """WITH {poses}, p AS (SELECT log, idx * 0.5e0 AS t, x FROM poses), e AS (SELECT log, max(t) AS t1 FROM p GROUP BY log),
b AS (SELECT log, t AS t0, x AS x0, lead(t) OVER w AS t2, lead(x) OVER w AS x2 FROM p WINDOW w AS (PARTITION BY log ORDER BY t)),
g AS (SELECT log, t1, k, least(k * 0.1e0, t1) AS t FROM e, range(0, 41) r(k))
SELECT g.log, CAST(g.k AS INTEGER) AS k, round(x0 + (t - t0) / (t2 - t0) * (x2 - x0), 5) AS x FROM g JOIN b ON g.log = b.log AND t2 IS NOT NULL AND t >= t0 AND (t < t2 OR (t = t1 AND t2 = t1))""",
)
def scoring_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).select("log", (F.col("idx") * 0.5).alias("t"), "x")
    return sequence.to_grid(own, "log", "t", ["x"], F.lit(0.0), 0.1, 40).select("log", "k", (F.round("x", 5) + 0.0).alias("x"))


@query(
    "lane_nearest",
    """WITH {poses}, q AS (SELECT token, x AS px, y AS py FROM poses), l AS (SELECT c_custkey AS lane_id, c_custkey % 3 = 0 AS on_route, c_custkey % 60 + 0.25e0 AS lx, c_custkey % 5 - 2e0 AS ly FROM customer),
d AS (SELECT token, lane_id, on_route, sqrt(power(lx - px, 2) + power(ly - py, 2)) AS d FROM q, l)
SELECT token, lane_id, round(d, 6) AS distance FROM d WHERE d <= 3 QUALIFY row_number() OVER (PARTITION BY token ORDER BY CASE WHEN on_route AND d <= 1 THEN 0 ELSE 1 END, d, lane_id) = 1""",
)
def lane_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = poses(spark, sf_dir).select("token", F.col("x").alias("px"), F.col("y").alias("py"))
    key = F.col("c_custkey")
    lanes = table(spark, sf_dir, "customer").select(key.alias("lane_id"), (key % 3 == 0).alias("on_route"), (key % 60 + 0.25).alias("x"), (key % 5 - 2.0).alias("y"))
    return spatial.nearest_lane(points, lanes, "token", 1.0, 3.0, 4.0).select("token", "lane_id", r6("distance").alias("distance"))


@query("lane_by_heading", "SELECT o_custkey, coalesce(min_by(o_orderkey, o_totalprice) FILTER (WHERE o_orderstatus = 'F'), max(o_orderkey)) AS lane_id FROM orders GROUP BY o_custkey")
def lane_by_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    hits = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("lane_id"), F.col("o_totalprice").alias("error"))
    near = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("lane_id"))
    return spatial.nearest_lane_by_heading(orders.select("o_custkey").distinct(), hits, near, "o_custkey")


@query("as_of_index", "WITH {frames}, c AS (SELECT log, idx AS slot, token AS map_token FROM frames) SELECT f.log, f.idx, c.map_token FROM frames f JOIN c ON c.log = f.log AND c.slot = f.idx // 5")
def as_of_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir)
    cached = own.select("log", F.col("idx").alias("slot"), F.col("token").alias("map_token"))
    return spatial.as_of_index(own.select("log", "idx"), cached, ["log"], "idx", 5)


@query(
    "corridor",
    """WITH {poses}, s AS (SELECT CASE WHEN log % 2 = 0 THEN 1 ELSE 0 END AS g, token, x, y FROM poses)
SELECT token FROM s WHERE x - 0.5e0 <= 31 AND x + 0.5e0 >= -1 AND abs(y) - 0.25e0 <= 0.3e0 + 1e-9""",
)
def corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight corridor of several points, against axis-parallel boxes."""
    points = spark.range(4).select(F.lit(1).alias("g"), F.col("id").alias("k"), (F.col("id") * 10.4 - 0.7).alias("x"), F.lit(0.0).alias("y")).withColumn("x", F.when(F.col("k") == 3, 30.7).otherwise(F.col("x")))
    flat = poses(spark, sf_dir).withColumn("h", F.lit(0.0))
    objects = spatial.with_box(flat, "b", 1.0, 0.5, heading="h").select(F.lit(1).alias("g"), "token", *[f"b{a}{i}" for i in range(4) for a in "xy"])
    return spatial.corridor_join(points, objects, ["g"], "k", 0.3).select("token")


@query(
    "corridor_bends",
    """WITH {poses}, pt AS (SELECT log, idx, x, y * 4 AS y FROM poses),
seg AS (SELECT log, idx, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w IS NULL AS first, lead(x, 2) OVER w IS NULL AS last FROM pt WINDOW w AS (PARTITION BY log ORDER BY idx) QUALIFY x1 IS NOT NULL),
box AS (SELECT log, x0, y0, atan2(y1 - y0, x1 - x0) AS eh, (sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) + CASE WHEN first THEN 0.3e0 ELSE 0 END + CASE WHEN last THEN 0.3e0 ELSE 0 END) / 2 AS el, 0.3e0 AS ew,
(x0 + x1) / 2 + cos(atan2(y1 - y0, x1 - x0)) * (CASE WHEN last THEN 0.15e0 ELSE 0 END - CASE WHEN first THEN 0.15e0 ELSE 0 END) AS ex,
(y0 + y1) / 2 + sin(atan2(y1 - y0, x1 - x0)) * (CASE WHEN last THEN 0.15e0 ELSE 0 END - CASE WHEN first THEN 0.15e0 ELSE 0 END) AS ey, first FROM seg),
obj AS (SELECT log, token, x + 0.4e0 AS ox, y * 3 + 1.1e0 AS oy, heading AS oh, 0.4e0 AS ol, 0.2e0 AS ow FROM poses),
pairs AS (SELECT token, b.*, o.* EXCLUDE (log, token) FROM box b JOIN obj o USING (log)),
sep AS (SELECT token, x0, y0, a, abs((ox - ex) * cos(a) + (oy - ey) * sin(a)) AS gap, el * abs(cos(eh - a)) + ew * abs(sin(eh - a)) + ol * abs(cos(oh - a)) + ow * abs(sin(oh - a)) AS reach
FROM (SELECT *, unnest([eh, eh + pi() / 2, oh, oh + pi() / 2]) AS a FROM pairs)),
met AS (SELECT token FROM sep GROUP BY token, x0, y0 HAVING bool_and(gap <= reach + 1e-9)
UNION SELECT token FROM pairs WHERE NOT first AND sqrt(power(greatest(abs((x0 - ox) * cos(oh) + (y0 - oy) * sin(oh)) - ol, 0), 2) + power(greatest(abs((y0 - oy) * cos(oh) - (x0 - ox) * sin(oh)) - ow, 0), 2)) <= 0.3e0 + 1e-9)
SELECT DISTINCT token FROM met""",
)
def corridor_bends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole track of each log as one corridor with bends, against turned boxes beside it."""
    own = poses(spark, sf_dir)
    track = own.select("log", "idx", "x", (F.col("y") * 4).alias("y"))
    beside = own.select("log", "token", (F.col("x") + 0.4).alias("x"), (F.col("y") * 3 + 1.1).alias("y"), "heading")
    objects = spatial.with_box(beside, "b", 0.8, 0.4).select("log", "token", *[f"b{a}{i}" for i in range(4) for a in "xy"])
    return spatial.corridor_join(track, objects, ["log"], "idx", 0.3).select("token")


#: Rings of unit cells that are not convex (two of the three); fixed values.
_BLOCKS = {0: ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)), 1: ((0, 0), (1, 0), (1, 2), (3, 2), (3, 0), (4, 0), (4, 3), (0, 3)), 2: ((0, 0), (2, 0), (2, 3), (0, 3))}
_BLOCK_SQL = ", ".join(f"({k}, {i}, {x}, {y})" for k, ring in _BLOCKS.items() for i, (x, y) in enumerate(ring))


@query(
    "route_loops",
    f"""WITH v(shape, k, x, y) AS (VALUES {_BLOCK_SQL}), n AS (SELECT shape, count(*) AS n FROM v GROUP BY shape),
cell AS (SELECT e.shape, cx, cy FROM (SELECT a.shape, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM v a JOIN n USING (shape) JOIN v b ON a.shape = b.shape AND b.k = (a.k + 1) % n.n) e, range(0, 4) r(cx), range(0, 4) s(cy)
GROUP BY e.shape, cx, cy HAVING count(*) FILTER (WHERE (ay > cy + 0.5e0) <> (b_y > cy + 0.5e0) AND cx + 0.5e0 < ax) % 2 = 1),
block AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS idx, l_returnflag <> 'R' AS connector, l_quantity % 3 AS shape, l_partkey % 9 AS x, l_suppkey % 7 AS y FROM lineitem),
held AS (SELECT route, idx, x + cx AS cx, y + cy AS cy FROM block b JOIN cell c ON b.shape = c.shape WHERE connector),
ends AS (SELECT route, min(idx) AS stop FROM (SELECT a.route, a.idx FROM held a JOIN held b ON a.route = b.route AND a.idx > b.idx AND a.cx = b.cx AND a.cy = b.cy) GROUP BY route)
SELECT b.route, b.idx FROM block b LEFT JOIN ends e ON b.route = e.route WHERE e.route IS NULL OR b.idx < e.stop""",
)
def route_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routes whose blocks are shapes on a grid of 1.1 m; the SQL looks for a cell that two blocks share."""
    x, y = F.col("l_partkey") % 9, F.col("l_suppkey") % 7
    shape = F.col("l_quantity") % 3
    shapes = F.array(*[F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring]) for _, ring in sorted(_BLOCKS.items())])
    ring = F.transform(F.get(shapes, shape.cast("int")), lambda p: F.struct((1.1 * (p.x + x)).alias("x"), (1.1 * (p.y + y)).alias("y")))
    along = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), F.row_number().over(along).cast("long").alias("idx"), (F.col("l_returnflag") != "R").alias("connector"), ring.alias("ring"))
    return polygons.cut_loops(blocks, "route", "idx", "connector").select("route", "idx")


@query(
    "area_flags",
    """WITH h AS (SELECT l_orderkey AS token, l_linenumber - 1 AS corner, l_suppkey % 4 AS polygon_id, CASE WHEN l_returnflag = 'N' THEN 'LANE' ELSE 'CARPARK_AREA' END AS layer, l_linestatus = 'O' AS on_route FROM lineitem WHERE l_linenumber <= 5),
p AS (SELECT token, polygon_id, count(DISTINCT corner) AS n FROM h WHERE corner < 4 AND layer = 'LANE' GROUP BY ALL), l AS (SELECT token, count(*) AS lanes, max(n) AS most FROM p GROUP BY token),
c AS (SELECT token, count(DISTINCT corner) AS covered FROM h WHERE corner < 4 GROUP BY token), o AS (SELECT DISTINCT token FROM h WHERE corner = 4 AND layer = 'LANE' AND on_route)
SELECT o_orderkey AS token, coalesce(lanes, 0) > 1 AND coalesce(most, 0) < 4 AS multi_lane, coalesce(covered, 0) < 4 AS off_road, o.token IS NULL AS oncoming
FROM orders LEFT JOIN l ON l.token = o_orderkey LEFT JOIN c ON c.token = o_orderkey LEFT JOIN o ON o.token = o_orderkey""",
)
def area_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select(
        F.col("l_orderkey").alias("token"),
        (F.col("l_linenumber") - 1).alias("corner"),
        (F.col("l_suppkey") % 4).alias("polygon_id"),
        F.when(F.col("l_returnflag") == "N", "LANE").otherwise("CARPARK_AREA").alias("layer"),
        (F.col("l_linestatus") == "O").alias("on_route"),
    )
    return spatial.ego_area_flags(hits, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token")), ["token"])


@query(
    "extrapolated",
    """WITH {poses} SELECT token, round(x + y * 2, 6) AS x2, round(y + heading * 2, 6) + 0e0 AS y2, round(CASE WHEN y * cos(heading) + heading * sin(heading) < 0 THEN atan2(sin(heading + pi()), cos(heading + pi())) ELSE heading END, 6) + 0e0 AS h2 FROM poses""",
)
def extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, h = spatial.extrapolated(*[F.col(c) for c in ("x", "y", "heading", "y", "heading")], F.lit(2.0))
    return poses(spark, sf_dir).select("token", r6(x).alias("x2"), r6(y).alias("y2"), r6(h).alias("h2"))


#: A ring that is not convex, laid at a place of each customer's own; fixed values.
_NOTCH = ((0.03, 0.02), (2.03, 0.02), (2.03, 1.33), (1.03, 0.63), (0.03, 1.33))


@query(
    "bev_raster",
    f"""WITH p AS (SELECT c_custkey AS z, c_mktsegment AS label, c_custkey % 40 * 1e0 AS ox, floor(c_custkey / 40) * 0.7e0 AS oy FROM customer),
v(k, x, y) AS (VALUES {", ".join(f"({k}, {x}e0, {y}e0)" for k, (x, y) in enumerate(_NOTCH))}),
e AS (SELECT a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM v a JOIN v b ON b.k = (a.k + 1) % 5),
c AS (SELECT z, label, ox, oy, CAST(floor(ox / 0.25e0) AS BIGINT) + i AS col, CAST(floor(oy / 0.25e0) AS BIGINT) + j AS "row" FROM p, range(-1, 11) r(i), range(-1, 9) s(j)),
m AS (SELECT *, (col + 0.5e0) * 0.25e0 - ox AS px, ("row" + 0.5e0) * 0.25e0 - oy AS py FROM c),
held AS (SELECT "row", col, z, label FROM m, e GROUP BY "row", col, z, label HAVING count(*) FILTER (WHERE (ay > py) <> (ay + dy > py) AND px < dx * (py - ay) / nullif(dy, 0) + ax) % 2 = 1)
SELECT "row", col, max_by(label, z) AS label FROM held GROUP BY "row", col""",
)
def bev_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as notched shapes that overlap; a later key overwrites an earlier."""
    key = F.col("c_custkey")
    at = F.struct((key % 40).cast("double").alias("x"), (F.floor(key / 40) * 0.7).alias("y"))
    ring = F.array(*[F.struct((F.lit(x) + at["x"]).alias("x"), (F.lit(y) + at["y"]).alias("y")) for x, y in _NOTCH])
    own = table(spark, sf_dir, "customer").select(key.alias("z"), F.col("c_mktsegment").alias("label"), ring.alias("ring"))
    return spatial.rasterise(own, 0.25, "z", "label")


@query(
    "map_radius",
    """WITH {poses}, v(polygon_id, k, x, y) AS (VALUES (0, 0, 0.03e0, 0.02e0), (0, 1, 30.03e0, 0.02e0), (0, 2, 30.03e0, 0.33e0), (0, 3, 15.03e0, 0.13e0), (0, 4, 0.03e0, 0.33e0),
(1, 0, 10.03e0, -0.61e0), (1, 1, 60.03e0, -0.61e0), (1, 2, 60.03e0, 0.053e0), (1, 3, 35.03e0, -0.21e0), (1, 4, 10.03e0, 0.053e0)),
e AS (SELECT a.polygon_id, a.x AS ax, a.y AS ay, b.x - a.x AS dx, b.y - a.y AS dy FROM v a JOIN v b ON a.polygon_id = b.polygon_id AND b.k = (a.k + 1) % 5),
p AS (SELECT token, x AS px, heading AS py FROM poses),
d AS (SELECT token, polygon_id, ax, ay, dx, dy, px, py, least(greatest(((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy), 0), 1) AS t FROM p, e)
SELECT token, polygon_id FROM d GROUP BY ALL HAVING min(sqrt(power(px - ax - t * dx, 2) + power(py - ay - t * dy, 2))) <= 2 OR count(*) FILTER (WHERE (ay > py) <> (ay + dy > py) AND px < dx * (py - ay) / nullif(dy, 0) + ax) % 2 = 1""",
)
def map_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = spark.range(2).select(F.col("id").cast("int").alias("polygon_id"), F.when(F.col("id") == 0, _ring(0)).otherwise(_ring(1)).alias("ring"))
    points = poses(spark, sf_dir).select("token", F.col("x").alias("px"), F.col("heading").alias("py"))
    return spatial.within_radius(points, polygons, "token", 2.0)


@query("box_to_global", "WITH {poses} SELECT token, round(x + 2 * cos(heading) - 1 * sin(heading), 6) + 0e0 AS gx, round(y + 2 * sin(heading) + 1 * cos(heading), 6) + 0e0 AS gy FROM poses")
def box_to_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, _ = geo.to_global(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.col("x"), F.col("y"), F.col("heading"))
    return poses(spark, sf_dir).select("token", r6(x).alias("gx"), r6(y).alias("gy"))


@query("job_summary", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS successes, count(*) FILTER (WHERE o_orderstatus <> 'F') AS failures FROM orders GROUP BY 1")
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(done).alias("successes"), F.count_if(~done).alias("failures"))


@query(
    "occupancy_forecast",
    """WITH {poses}, o AS (SELECT log, token, event_type AS type, abs(value - 50) AS distance, x, y, heading, CASE WHEN event_type = 'error' THEN NULL ELSE y END AS vx, heading AS vy0 FROM poses),
k AS (SELECT *, CASE WHEN vx IS NULL THEN NULL ELSE type END AS part FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY log, part ORDER BY distance, token) AS rank FROM k),
kept AS (SELECT * FROM r WHERE rank <= CASE WHEN vx IS NULL THEN 4 WHEN type = 'click' THEN 3 WHEN type = 'view' THEN 2 ELSE 0 END)
SELECT log, CAST(t AS INTEGER) AS t, token AS track_token, round(x + coalesce(vx, 0) * t * 0.1e0, 6) AS x, round(y + CASE WHEN vx IS NULL THEN 0 ELSE vy0 END * t * 0.1e0, 6) + 0e0 AS y FROM kept, range(0, 9, 4) g(t)""",
)
def occupancy_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbline.operators.forecast import constant_velocity_occupancy

    moves = F.col("event_type") != "error"
    objects = poses(spark, sf_dir).select(
        "log", F.col("token").alias("track_token"), F.col("event_type").alias("type"), F.abs(F.col("value") - 50).alias("distance"), "x", "y", "heading", F.when(moves, F.col("y")).alias("vx"), F.when(moves, F.col("heading")).alias("vy")
    )
    got = constant_velocity_occupancy(objects, "log", 8, 4, 0.1, {"click": 3, "view": 2}, 4)
    return got.select("log", "t", "track_token", r6("x").alias("x"), r6("y").alias("y"))


@query(
    "rigid_chain",
    """WITH {poses}, s AS (SELECT token, x, y, heading AS h FROM poses), e AS (SELECT token, x, y, h, cos(0.3e0) * 2 - sin(0.3e0) * 1 + 0.5e0 AS ex, sin(0.3e0) * 2 + cos(0.3e0) * 1 AS ey FROM s)
SELECT token, round(cos(h) * ex - sin(h) * ey + x, 6) + 0e0 AS gx, round(sin(h) * ex + cos(h) * ey + y, 6) + 0e0 AS gy, 1.5e0 + 1 AS gz FROM e""",
)
def rigid_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    zero, sensor = F.lit(0.0), tuple(map(F.lit, (math.cos(0.15), 0.0, 0.0, math.sin(0.15))))
    ego = (F.cos(F.col("heading") / 2), zero, zero, F.sin(F.col("heading") / 2))
    p = geo.rigid(ego, (F.col("x"), F.col("y"), F.lit(1.0)), geo.rigid(sensor, (F.lit(0.5), zero, zero), tuple(map(F.lit, (2.0, 1.0, 1.5)))))
    return poses(spark, sf_dir).select("token", *[r6(c).alias(n) for c, n in zip(p, ("gx", "gy", "gz"), strict=True)])


@query(
    "chat_answer",
    """SELECT o_orderkey, '<think>' || chr(10) || CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 > 0 THEN 'look' WHEN o_orderstatus <> 'F' AND o_custkey % 3 > 0 THEN CASE WHEN o_custkey % 3 = 1 THEN 'look' ELSE '' END ELSE 'This is a simple scene.' END
|| chr(10) || '</think>' || chr(10) || '<answer>' || chr(10) || '<action_' || o_custkey || '>' || chr(10) || '</answer>' AS said FROM orders WHERE NOT (o_orderstatus = 'F' AND o_custkey % 3 = 2)""",
)
def chat_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbline.functions import text

    kind = F.when(F.col("o_orderstatus") == "F", "nuscenes").otherwise("nuplan")
    reasoning = F.when(F.col("o_custkey") % 3 == 1, "look").when(F.col("o_custkey") % 3 == 2, "")
    own = table(spark, sf_dir, "orders").where("NOT (o_orderstatus = 'F' AND o_custkey % 3 = 2)")
    return own.select("o_orderkey", text.chat_answer(kind, reasoning, text.action_text(F.array("o_custkey"))).alias("said"))
