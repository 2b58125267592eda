"""Codebook, open-loop evaluation and graph operators, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators import evaluation, graph, scoring, tokens
from kerbline.registry import poses, query, r6, table

# ------------------------------------------------------------------ codebook
_SEG_SQL = """{poses}, d AS (SELECT log, idx, x - lag(x, 1, x) OVER w AS dx0, y - lag(y, 1, y) OVER w AS dy0, lag(heading, 1, heading) OVER w AS ph, heading FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx)),
seg AS (SELECT log, idx, dx0 * cos(ph) + dy0 * sin(ph) AS dx, dy0 * cos(ph) - dx0 * sin(ph) AS dy, atan2(sin(heading - ph), cos(heading - ph)) AS dh FROM d)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.segments(poses(spark, sf_dir), "log", "idx")


def _codebook(spark: SparkSession) -> DataFrame:
    """Stay, forward, forward left, forward right: a tiny codebook of our own."""
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 0.2, 0.4), (3, 1.0, -0.2, -0.4)], "token_id int, x double, y double, h double")
    return rows.select("token_id", tokens.corners_array(F.col("x"), F.col("y"), F.col("h")).alias("corners"))


@query("segments", f"WITH {_SEG_SQL} SELECT log, idx, round(dx, 6) + 0e0 AS dx, round(dy, 6) + 0e0 AS dy, round(dh, 6) + 0e0 AS dh FROM seg")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).select("log", "idx", r6("dx").alias("dx"), r6("dy").alias("dy"), r6("dh").alias("dh"))


_CORNER = "(VALUES (1, 1), (1, -1), (-1, -1), (-1, 1)) k(a, b)"


@query(
    "codebook_nearest",
    f"""WITH {_SEG_SQL}, c(token_id, x, y, h) AS (VALUES (0, 0e0, 0e0, 0e0), (1, 1e0, 0e0, 0e0), (2, 1e0, 0.2e0, 0.4e0), (3, 1e0, -0.2e0, -0.4e0)),
j AS (SELECT log, idx, token_id, sum(sqrt(power(dx + a * 2.25e0 * cos(dh) - b * sin(dh) - (x + a * 2.25e0 * cos(h) - b * sin(h)), 2) + power(dy + a * 2.25e0 * sin(dh) + b * cos(dh) - (y + a * 2.25e0 * sin(h) + b * cos(h)), 2))) AS d
FROM seg, c, {_CORNER} GROUP BY ALL)
SELECT log, idx, CAST(token_id AS INTEGER) AS token_id, round(d, 5) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY log, idx ORDER BY round(d, 9), token_id) = 1""",
)
def codebook_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _segments(spark, sf_dir).select("log", "idx", tokens.corners_array(F.col("dx"), F.col("dy"), F.col("dh")).alias("corners"))
    return tokens.nearest_codes(own, _codebook(spark)).select("log", "idx", "token_id", (F.round("distance", 5) + 0.0).alias("distance"))


@query("codebook_means", "SELECT label AS token_id, count(*) AS members, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS y FROM embeddings GROUP BY label")
def codebook_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("token_id")).agg(F.count("*").alias("members"), r6(F.avg(e(0))).alias("x"), r6(F.avg(e(1))).alias("y"))


def _kdisk_sql(n: int, tolerance: float) -> str:
    """One seed a step: the smallest id that is left; what is near it goes."""
    corners = ", ".join(f"x + {a * 2.25} * cos(h) - {b} * sin(h) AS x{k}, y + {a * 2.25} * sin(h) + {b} * cos(h) AS y{k}" for k, (a, b) in enumerate(((1, 1), (1, -1), (-1, -1), (-1, 1))))
    apart = " + ".join(f"sqrt(power(l.x{k} - s.x{k}, 2) + power(l.y{k} - s.y{k}, 2))" for k in range(4))
    steps, parts = [], []
    for k in range(n):
        steps.append(f"met{k} AS MATERIALIZED (SELECT l.*, ({apart}) / 4 <= {tolerance} AS near FROM left{k} l, (SELECT * FROM left{k} ORDER BY id LIMIT 1) s), left{k + 1} AS MATERIALIZED (SELECT * EXCLUDE near FROM met{k} WHERE NOT near)")
        parts.append(f"SELECT CAST({k} AS INTEGER) AS token_id, round(avg(x), 6) + 0e0 AS x, round(avg(y), 6) + 0e0 AS y, round(avg(h), 6) + 0e0 AS heading, count(*) AS members FROM met{k} WHERE near HAVING count(*) > 0")
    points = f"left0 AS MATERIALIZED (SELECT id, x, y, h, {corners} FROM (SELECT log * 1000000 + idx AS id, dx AS x, dy AS y, dh AS h FROM seg))"
    return f"WITH {_SEG_SQL}, {points}, {', '.join(steps)} {' UNION ALL '.join(parts)}"


@query("kdisk_det", _kdisk_sql(8, 0.5))
def kdisk_det(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokens.exact_segments(poses(spark, sf_dir), "log", "idx").select((F.col("log") * 1000000 + F.col("idx")).alias("segment_id"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dh").alias("heading"))
    return tokens.disk_clusters(own, 8, 0.5).select("token_id", r6("x").alias("x"), r6("y").alias("y"), r6("heading").alias("heading"), "members")


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct((F.col("x") - F.col("ox")).alias("x"), F.col("y"), (F.col("heading") * 0).alias("heading"))
    own = poses(spark, sf_dir)
    origin = own.where("idx = 0").select("log", F.col("x").alias("ox"))
    rows = own.where("idx > 0").join(origin, "log").groupBy("log").agg(F.sort_array(F.collect_list(F.struct("idx", step.alias("p")))).alias("ps"))
    return rows.select("log", F.transform("ps", lambda q: q.p).alias("poses"))


@query(
    "tokenise_seq",
    f"""WITH RECURSIVE {{poses}}, c(token_id, wx, wy, wh) AS (VALUES (0, 0e0, 0e0, 0e0), (1, 1e0, 0e0, 0e0), (2, 1e0, 0.2e0, 0.4e0), (3, 1e0, -0.2e0, -0.4e0)),
o AS (SELECT log, x AS ox FROM poses WHERE idx = 0), t AS (SELECT p.log, p.idx, p.x - ox AS tx, p.y AS ty FROM poses p JOIN o ON p.log = o.log WHERE p.idx > 0),
r AS (SELECT log, CAST(0 AS BIGINT) AS idx, 0e0 AS x, 0e0 AS y, 0e0 AS h, '' AS tokens FROM (SELECT DISTINCT log FROM t) UNION ALL
SELECT log, idx, x + cos(h) * wx - sin(h) * wy, y + sin(h) * wx + cos(h) * wy, atan2(sin(h + wh), cos(h + wh)), tokens || CASE tokens WHEN '' THEN '' ELSE ' ' END || token_id FROM (
SELECT r.log, t.idx, r.x, r.y, r.h, r.tokens, c.*, sum(sqrt(power((tx - r.x) * cos(r.h) + (ty - r.y) * sin(r.h) + a * 2.25e0 * cos(-r.h) - b * sin(-r.h) - (wx + a * 2.25e0 * cos(wh) - b * sin(wh)), 2)
+ power((ty - r.y) * cos(r.h) - (tx - r.x) * sin(r.h) + a * 2.25e0 * sin(-r.h) + b * cos(-r.h) - (wy + a * 2.25e0 * sin(wh) + b * cos(wh)), 2))) AS d
FROM r JOIN t ON t.log = r.log AND t.idx = r.idx + 1, c, {_CORNER} GROUP BY r.log, t.idx, r.x, r.y, r.h, r.tokens, c.token_id, c.wx, c.wy, c.wh) QUALIFY row_number() OVER (PARTITION BY log ORDER BY d, token_id) = 1)
SELECT log, arg_max(tokens, idx) AS tokens FROM r GROUP BY log""",
)
def tokenise_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenise(_trajectories(spark, sf_dir), _codebook(spark), "log").select("log", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"))


@query(
    "rollout",
    """WITH RECURSIVE {poses}, seq AS (SELECT log, list(1 + token % 3 ORDER BY idx) AS t FROM poses GROUP BY log),
r AS (SELECT log, 0 AS step, t, 0e0 AS x, 0e0 AS y, 0e0 AS h FROM seq UNION ALL
SELECT log, step + 1, t, x + cos(h) * 1 - sin(h) * CASE t[step + 1] WHEN 2 THEN 0.2e0 WHEN 3 THEN -0.2e0 ELSE 0 END, y + sin(h) * 1 + cos(h) * CASE t[step + 1] WHEN 2 THEN 0.2e0 WHEN 3 THEN -0.2e0 ELSE 0 END,
h + CASE t[step + 1] WHEN 2 THEN 0.4e0 WHEN 3 THEN -0.4e0 ELSE 0 END FROM r WHERE step < len(t))
SELECT log, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, round(atan2(sin(h), cos(h)), 5) + 0e0 AS heading FROM r WHERE step = len(t)""",
)
def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).groupBy("log").agg(F.sort_array(F.collect_list(F.struct("idx", (1 + F.col("token") % 3).cast("int").alias("t")))).alias("s"))
    seq = own.select("log", F.transform("s", lambda q: q.t).alias("tokens"))
    last = F.element_at("poses", -1)
    r5 = lambda c: F.round(c, 5) + 0.0
    return tokens.rollout(seq, _codebook(spark), "log").select("log", r5(last.x).alias("x"), r5(last.y).alias("y"), r5(last.heading).alias("heading"))


@query("decode_ids", "SELECT o_orderkey, greatest(o_custkey - 100, 0) AS first_id, CAST(0 AS BIGINT) AS last_id FROM orders")
def decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = tokens.decode_ids(F.array("o_custkey"), 100, 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", ids[0].cast("long").alias("first_id"), ids[2].cast("long").alias("last_id"))


# ------------------------------------------------------------------ open-loop evaluation
_EVAL_SQL = "ev AS (SELECT l_orderkey AS token, l_linenumber AS step, min(l_extendedprice) / 10000 AS px, min(l_quantity) / 10 AS gx, min(l_discount) * 10 AS py, min(l_tax) * 10 AS gy, max(CASE WHEN l_linestatus = 'O' THEN 1e0 ELSE 0e0 END) AS m FROM lineitem GROUP BY ALL)"


def _eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("token"), F.col("l_linenumber").alias("step"))
    return lines.agg(
        (F.min("l_extendedprice") / 10000).alias("px"),
        (F.min("l_quantity") / 10).alias("gx"),
        (F.min("l_discount") * 10).alias("py"),
        (F.min("l_tax") * 10).alias("gy"),
        F.max(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)).alias("m"),
    )


@query("l2_by_step", f"WITH {_EVAL_SQL} SELECT step, count(*) AS n, round(sum(sqrt((power(px - gx, 2) + power(py - gy, 2)) * m)), 3) AS total, round(avg(sqrt((power(px - gx, 2) + power(py - gy, 2)) * m)), 6) AS mean FROM ev GROUP BY step")
def l2_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluation.l2(*[F.col(c) for c in ("px", "py", "gx", "gy", "m")])
    return evaluation.error_by_step(_eval(spark, sf_dir), e).select("step", "n", F.round("total", 3).alias("total"), r6("mean").alias("mean"))


@query(
    "stp3_vs_uniad",
    f"""WITH {_EVAL_SQL}, s AS (SELECT step, avg(sqrt((power(px - gx, 2) + power(py - gy, 2)) * m)) AS own FROM ev GROUP BY step)
SELECT step, round(own, 6) AS own, round(avg(own) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS so_far FROM s""",
)
def stp3_vs_uniad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluation.l2(*[F.col(c) for c in ("px", "py", "gx", "gy", "m")])
    steps = evaluation.error_by_step(_eval(spark, sf_dir), e).withColumn("all", F.lit(0))  # a handful of steps
    return evaluation.cumulative_mean(steps, "mean", ["all"]).select("step", r6("mean").alias("own"), r6("so_far").alias("so_far"))


_CELLS_SQL = "(SELECT unnest(range(-4, 6)) AS r) rr, (SELECT unnest(range(-2, 2)) AS c) cc"
_HITS_SQL = f"""{_EVAL_SQL}, occ AS (SELECT DISTINCT token, step, CAST(floor(gy * 4 / 0.5e0) + 100 AS BIGINT) AS "row", CAST(floor(gx * 4 / 0.5e0) + 100 AS BIGINT) AS col FROM ev WHERE m > 0),
ras AS (SELECT token, step, CAST(floor(py * 4 / 0.5e0) + 100 + r AS BIGINT) AS "row", CAST(floor(px * 4 / 0.5e0) + 100 + c AS BIGINT) AS col FROM ev, {_CELLS_SQL})"""


@query("raster_hit", f'WITH {_HITS_SQL} SELECT DISTINCT ras.token, ras.step FROM ras JOIN occ USING (token, step, "row", col) WHERE "row" BETWEEN 0 AND 199 AND col BETWEEN 0 AND 199')
def raster_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _eval(spark, sf_dir)
    at = lambda c: (F.floor(F.col(c) * 4 / 0.5) + 100).cast("long")
    occupied = own.where("m > 0").select("token", "step", at("gy").alias("row"), at("gx").alias("col")).distinct()
    return evaluation.hits(own, occupied, ["token", "step"], F.col("px") * 4, F.col("py") * 4)


@query("free_collisions", f"WITH {_EVAL_SQL} SELECT token, step, px > 5 AS hit FROM ev WHERE NOT gx > 4")
def free_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, on = _eval(spark, sf_dir), ["token", "step"]
    return evaluation.collisions_where_truth_is_free(own, own.where("gx > 4").select(*on), own.where("px > 5").select(*on), on)


@query("eval_usable", f"WITH {_EVAL_SQL} SELECT token, step, px, gx FROM ev WHERE m > 0 AND token % 2 = 0")
def eval_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _eval(spark, sf_dir)
    on = ["token", "step"]
    return evaluation.usable(own.select(*on, "px"), own.select(*on, "gx"), own.select(*on, "m"), own.where("token % 2 = 0"), on).select(*on, "px", "gx")


# ------------------------------------------------------------------ graph
_EDGES_SQL = "edges AS (SELECT DISTINCT o_custkey % 200 AS src, o_orderkey % 200 AS dst FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders")
    return own.select((F.col("o_custkey") % 200).alias("src"), (F.col("o_orderkey") % 200).alias("dst")).distinct()


@query(
    "bfs_reach",
    f"""WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS node, 0 AS depth FROM nation UNION SELECT r.source, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 3)
SELECT source, node, min(depth) AS depth FROM r GROUP BY ALL""",
)
def bfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    return graph.reach(_edges(spark, sf_dir), sources, 3)


@query(
    "shortest_path",
    f"""WITH RECURSIVE {_EDGES_SQL}, r AS (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey AS BIGINT) AS node, 0 AS depth FROM nation UNION SELECT r.source, e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 4),
m AS (SELECT source, node, min(depth) AS depth FROM r GROUP BY ALL)
SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_nationkey + 50 AS BIGINT) AS target, depth AS hops FROM nation LEFT JOIN m ON source = n_nationkey AND node = n_nationkey + 50""",
)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"), (F.col("n_nationkey") + 50).cast("long").alias("target"))
    return graph.shortest_hops(_edges(spark, sf_dir), pairs, 4)


@query("route_lanes", "SELECT o_custkey AS token, min(o_orderkey) AS pos, n_nationkey AS lane_id FROM orders JOIN nation ON o_orderkey % 5 = n_regionkey GROUP BY o_custkey, o_orderkey % 5, n_nationkey")
def route_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 5).alias("roadblock_id"))
    lanes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lane_id"), F.col("n_regionkey").alias("roadblock_id"))
    return graph.lanes_of_route(route, lanes)


@query("top_rank_ties", "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY abs(CAST(embedding[1] AS DOUBLE)), vec_id) AS r FROM embeddings) WHERE r <= 3")
def top_rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").withColumn("d", F.abs(F.get("embedding", F.lit(0)).cast("double")))
    return scoring.nearest_k(own, ["label"], "d", "vec_id", F.lit(3)).select("label", "vec_id")


@query(
    "search_paths",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
edges AS (SELECT DISTINCT ON (src, dst) src, dst, place FROM (SELECT c_custkey % n AS src, (c_custkey * 2 + 1) % n AS dst, 0 AS place FROM customer, n UNION ALL SELECT c_custkey % n, (c_custkey * 3 + c_nationkey) % n, 1 FROM customer, n) ORDER BY src, dst, place),
r AS (SELECT c_custkey AS token, c_custkey % n AS node, 1 AS depth, [0] AS key, [c_custkey % n] AS path FROM customer, n
UNION ALL SELECT r.token, e.dst, depth + 1, list_append(key, e.place), list_append(path, e.dst) FROM r JOIN edges e ON e.src = r.node WHERE depth <= 4),
goals AS (SELECT c_custkey AS token, (c_custkey * 5 + 3) % n AS goal FROM customer, n UNION SELECT c_custkey, (c_custkey * 11 + 1) % n FROM customer, n),
met AS (SELECT r.token, node, depth FROM r JOIN goals g ON r.token = g.token AND r.node = g.goal WHERE depth <= 4 QUALIFY row_number() OVER (PARTITION BY r.token ORDER BY depth, key) = 1),
won AS (SELECT r.token, r.path FROM r JOIN met USING (token, node, depth) QUALIFY row_number() OVER (PARTITION BY r.token ORDER BY key DESC) = 1),
deep AS (SELECT token, path FROM r QUALIFY row_number() OVER (PARTITION BY token ORDER BY depth DESC, key DESC) = 1)
SELECT d.token, array_to_string(coalesce(w.path, d.path), '>') AS path, w.path IS NOT NULL AS found FROM deep d LEFT JOIN won w ON w.token = d.token""",
)
def search_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every customer to the first of two goals, four levels deep, in a graph of two edges a node."""
    own = table(spark, sf_dir, "customer")
    n = own.count()
    k = F.col("c_custkey")
    edges = own.select((k % n).alias("src"), F.explode(F.array(F.struct(((k * 2 + 1) % n).alias("dst"), F.lit(0).alias("place")), F.struct(((k * 3 + F.col("c_nationkey")) % n).alias("dst"), F.lit(1).alias("place")))).alias("e"))
    edges = edges.groupBy("src", F.col("e.dst").alias("dst")).agg(F.min("e.place").alias("place"))
    goals = own.select(k.alias("token"), F.explode(F.array((k * 5 + 3) % n, (k * 11 + 1) % n)).alias("goal"))
    found = graph.search_paths(edges, own.select(k.alias("token"), (k % n).alias("start")), goals, 4)
    return found.select("token", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "found")
