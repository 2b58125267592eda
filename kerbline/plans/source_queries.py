"""Sources and sinks as round trips, and the remaining operators, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import classify, draws, geometry as geo
from kerbline.operators import filters, forecast, graph, linked, planner, planning, scenes, sequence, vocabulary
from kerbline.plans import builders, config, score_queries
from kerbline.registry import frames, poses, query, r6, table
from kerbline.session import scratch
from kerbline.sources import logs, nested, points, records, samples


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(F.concat(F.lit("log"), (F.col("log") % 16).cast("string")).alias("log_name"), F.concat(F.lit("t"), F.col("token").cast("string")).alias("token"), "idx", "value")


_LOGGED = "logged AS (SELECT 'log' || log % 16 AS log_name, 't' || token AS token, idx, value FROM frames)"


@query("log_round_trip", f"WITH {{frames}}, {_LOGGED} SELECT log_name, token, idx, value FROM logged WHERE log_name IN ('log3', 'log5')")
def log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "log")
    logs.write_log(_logged(spark, sf_dir), path)
    return logs.read_log(spark, path, ["log3", "log5"]).select("log_name", "token", "idx", "value")


@query("raw_log_scan", f"WITH {{frames}}, {_LOGGED} SELECT log_name, token, CAST(idx AS INTEGER) AS frame_idx, value AS speed FROM logged")
def raw_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "raw")
    _logged(spark, sf_dir).select("log_name", "token", F.col("idx").cast("int").alias("frame_idx"), F.array("value").alias("ego_dynamic_state")).write.json(path)
    return logs.read_raw_log(spark, path).select("log_name", "token", "frame_idx", F.get("ego_dynamic_state", F.lit(0)).alias("speed"))


@query("cache_round_trip", f"WITH {{frames}}, {_LOGGED} SELECT log_name, token, value FROM logged")
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "cache")
    logs.write_cache(_logged(spark, sf_dir), path)
    return spark.read.parquet(path).select("log_name", "token", "value")


@query("cache_point_read", f"WITH {{frames}}, {_LOGGED} SELECT token, idx, value FROM logged WHERE token = 't77'")
def cache_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "cache")
    logs.write_cache(_logged(spark, sf_dir), path)
    return logs.cached_token(spark, path, "t77").select("token", "idx", "value")


@query("cache_index", "SELECT 't' || event_id AS token, '/cache/log' || user_id || '/unknown/t' || event_id || '/metric_cache.pkl' AS path FROM events")
def cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "index")
    files = table(spark, sf_dir, "events").select(F.concat(F.lit("/cache/log"), "user_id", F.lit("/unknown/t"), "event_id", F.lit("/metric_cache.pkl")).alias("path"))
    logs.write_index(files, path)
    return logs.cache_index(spark, path)


@query("cache_export", f"WITH {{frames}}, {_LOGGED} SELECT CAST(1 AS BIGINT) AS files, count(*) AS n, round(sum(value), 3) AS total FROM logged")
def cache_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "export")
    logs.export_cache(_logged(spark, sf_dir), path)
    return spark.read.parquet(path).select("value", F.input_file_name().alias("file")).agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("score_file", f"WITH {{frames}}, {score_queries._SCORES_SQL} SELECT CAST(token AS VARCHAR) AS token, CAST(valid AS VARCHAR) AS valid, round(score, 6) AS score FROM scored")
def score_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "scores")
    logs.write_scores(score_queries.scores(spark, sf_dir).select("token", "valid", "score"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select("token", "valid", r6(F.col("score").cast("double")).alias("score"))


_SUBMITTED = "SELECT token, x, y FROM poses"


@query("submission_round_trip", f"WITH {{poses}} SELECT token, 'ours' AS team, CAST(0 AS INTEGER) AS seed, round(x, 6) AS x FROM poses")
def submission_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "submission")
    logs.write_submission(poses(spark, sf_dir).select(F.lit(0).alias("seed"), "token", F.array(F.struct("x", "y", "heading")).alias("poses")), path, "ours")
    return logs.read_submission(spark, path).select("token", "team", "seed", r6(F.get("poses", F.lit(0)).x).alias("x"))


@query("submission_merge", "SELECT event_id AS token, CAST(seed AS INTEGER) AS seed FROM events, (SELECT unnest([0, 1]) AS seed)")
def submission_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "events").select(F.col("event_id").alias("token"))
    parts = []
    for seed in (0, 1):
        path = scratch(spark, "submission")
        logs.write_submission(expected.select(F.lit(seed).alias("seed"), "token"), path, "ours")
        parts.append(logs.read_submission(spark, path))
    return logs.merge_submissions(parts, expected).select("token", "seed")


@query("report_round_trip", "SELECT o_orderkey AS token, o_totalprice AS duration FROM orders")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.lit(0.0).alias("start_time"), F.col("o_totalprice").alias("end_time"))
    logs.write_report(own, path)
    return spark.read.parquet(path).select("token", "duration")


@query("json_dump", "SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs.as_json(table(spark, sf_dir, "customer"), "c_custkey")
    return rows.select("c_custkey", F.get_json_object("json", "$.c_name").alias("name"), F.get_json_object("json", "$.c_nationkey").cast("int").alias("nation"))


@query(
    "sample_round_trip",
    """SELECT 's' || o_orderkey AS token, CASE o_orderkey % 3 WHEN 0 THEN 'a' || chr(10) || 'b' WHEN 1 THEN 'plain' ELSE '' END AS cot_text, o_orderkey % 3 <> 2 AS has_cot, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n_speeds, '/sensors' AS sensor_root FROM orders""",
)
def sample_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, key = scratch(spark, "samples"), F.col("o_orderkey")
    cot = F.when(key % 3 == 0, '["a","b"]').when(key % 3 == 1, "plain").otherwise("[]")
    speed = F.when(key % 2 == 0, "3.5").otherwise("[1.0,2.0]")
    samples.write_samples(table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), key).alias("token"), F.lit("nuplan").alias("dataset_name"), cot.alias("cot_output"), speed.alias("velocity")), path)
    return samples.read_samples(spark, {path: "/sensors"}, lines=True).select("token", "cot_text", "has_cot", F.size("velocity").alias("n_speeds"), "sensor_root")


@query(
    "sample_files",
    """SELECT 's' || s_suppkey AS token, s_name || chr(10) || 'said "' || s_nationkey || '"' AS cot_text, true AS has_cot, s_suppkey % 3 = 0 OR s_suppkey = 0 AS again, list_value(CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE s_suppkey / 2e0 END) AS velocity FROM supplier""",
)
def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a file; every third is written again, and the later one stands."""
    path, key = scratch(spark, "sample-files"), F.col("s_suppkey")
    text = F.concat("s_name", F.lit('\nsaid "'), "s_nationkey", F.lit('"'))
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key).alias("token"), F.lit("nuplan").alias("dataset_name"), text.alias("cot_output"), (key / 2).alias("velocity"), (key % 3 == 0).alias("_again"))
    samples.write_sample_files(own.drop("_again"), path)
    samples.write_sample_files(own.where("_again").drop("_again").withColumn("velocity", F.lit(0.0)), path)
    found = samples.read_samples(spark, {path: "/sensors"})
    return found.select("token", "cot_text", "has_cot", (F.get("velocity", F.lit(0)) == 0).alias("again"), "velocity")


@query("nested_qa", "SELECT CAST(o_custkey AS VARCHAR) AS scene, CAST(o_orderkey AS VARCHAR) AS frame, o_orderstatus AS kind, o_orderpriority AS \"Q\", 'A' || o_orderkey AS \"A\" FROM orders")
def nested_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    pairs = F.array(F.struct(F.col("o_orderpriority").alias("Q"), F.concat(F.lit("A"), key).alias("A")))
    body = F.struct(F.create_map("o_orderstatus", pairs).alias("QA"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("scene")).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), body.alias("v")))).alias("key_frames"))
    return samples.explode_qa(rows)


@query("linked_order", "SELECT event_id AS token, row_number() OVER w - 1 AS idx, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def linked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("token"), "ts")
    return samples.order_linked(own, "user_id", "ts").select("token", F.col("idx").cast("long").alias("idx"), "prev", "next")


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that name the frame before and after; nothing else tells their order."""
    w = sequence.along("log", "idx")
    own = poses(spark, sf_dir).select("token", F.lag("token").over(w).alias("prev"), F.lead("token").over(w).alias("next"), "x", "y", "heading")
    return own


@query("linked_ranks", "WITH {frames} SELECT token, first_value(token) OVER (PARTITION BY log ORDER BY idx) AS head, CAST(idx AS BIGINT) AS idx, false AS cyclic FROM frames")
def linked_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked.rank_lists(_linked(spark, sf_dir))


@query(
    "linked_trajectories",
    """WITH {poses}, ends AS (SELECT *, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, coalesce(nth_value(x, 2) OVER w, first_value(x) OVER w) AS x1, coalesce(nth_value(y, 2) OVER w, first_value(y) OVER w) AS y1,
last_value(x) OVER w AS xn, last_value(y) OVER w AS yn, count(*) OVER w AS n FROM poses WINDOW w AS (PARTITION BY log ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT token, x, y, heading, least(idx, 3) + 1 AS n_past, least(n - 1 - idx, 16) + 1 AS n_future,
coalesce(lag(x, 3) OVER w, x0 - (3 - idx) * (x1 - x0)) AS bx, coalesce(lag(y, 3) OVER w, y0 - (3 - idx) * (y1 - y0)) AS b_y,
coalesce(lead(x, 8) OVER w, xn) AS mx, coalesce(lead(y, 8) OVER w, yn) AS my, coalesce(lead(x, 16) OVER w, xn) AS fx, coalesce(lead(y, 16) OVER w, yn) AS fy FROM ends WINDOW w AS (PARTITION BY log ORDER BY idx))
SELECT token, CAST(n_past AS INTEGER) AS n_past, CAST(n_future AS INTEGER) AS n_future,
round((bx - x) * cos(heading) + (b_y - y) * sin(heading), 6) + 0e0 AS past_x, round((b_y - y) * cos(heading) - (bx - x) * sin(heading), 6) + 0e0 AS past_y,
round((mx - x) * cos(heading) + (my - y) * sin(heading), 6) + 0e0 AS middle_x, round((my - y) * cos(heading) - (mx - x) * sin(heading), 6) + 0e0 AS middle_y,
round((fx - x) * cos(heading) + (fy - y) * sin(heading), 6) + 0e0 AS future_x, round((fy - y) * cos(heading) - (fx - x) * sin(heading), 6) + 0e0 AS future_y FROM p""",
)
def linked_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames back and sixteen ahead along the links, in each frame's own coordinates."""
    own = _linked(spark, sf_dir)
    ranked = own.join(linked.rank_lists(own), "token")
    found = linked.history_and_future(ranked, back=3, ahead=16)
    at = lambda c, k, a: r6(F.get(c, F.lit(k)).getField(a))
    places = {"past": ("past", 0), "middle": ("future", 8), "future": ("future", 16)}
    return found.select("token", "n_past", "n_future", *[at(c, k, a).alias(f"{name}_{a}") for name, (c, k) in places.items() for a in "xy"])


@query("video_items", "SELECT l_orderkey AS token, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS position, 'img' || l_linenumber AS image FROM lineitem")
def video_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda n: F.concat(F.lit("img"), n.cast("string")))
    return samples.message_items(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("token")).agg(images.alias("images")))


@query("files_scan", "SELECT CAST(count(DISTINCT c_nationkey) AS BIGINT) AS files, CAST(sum(length(c_name) + 1) AS BIGINT) AS bytes FROM customer")
def files_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "files")
    table(spark, sf_dir, "customer").select("c_nationkey", "c_name").repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    found = samples.read_files(spark, path, with_content=True, pattern="*.txt")
    return found.agg(F.count("*").alias("files"), F.sum(F.length("content")).cast("long").alias("bytes"))


@query("frame_files", "SELECT 'seq' || user_id AS sequence, 'front' AS camera, CAST(event_id AS INTEGER) AS number FROM events")
def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "events").select(F.concat(F.lit("/data/seq"), "user_id", F.lit("/front/"), F.lpad(F.col("event_id").cast("string"), 9, "0"), F.lit(".jpg")).alias("path"))
    return samples.frame_numbers(paths)


@query("complete_folders", "SELECT l_orderkey AS token FROM (SELECT l_orderkey, l_linenumber, bool_or(l_suppkey % 5 <> 0) AS there FROM lineitem GROUP BY ALL) GROUP BY l_orderkey HAVING bool_and(there)")
def complete_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("token"), "l_linenumber", "l_suppkey")
    return samples.complete_sequences(own.where("l_suppkey % 5 <> 0"), own.select("token", "l_linenumber").distinct(), ["token", "l_linenumber"], "token")


@query("record_store", "SELECT 'k42' AS key, c_name AS payload FROM customer WHERE c_custkey = 42")
def record_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    own = table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("key"), F.col("c_name").alias("payload"))
    for _ in range(2):  # the second call finds the store made
        records.build_store(own, "key", path)
    return records.stored(spark, path, "key", "k42")


@query("record_files", "SELECT c_name || ':' || c_custkey AS payload, octet_length(encode(c_name || ':' || c_custkey)) AS n_bytes FROM customer")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as checked records of a few files, read back in byte ranges."""
    path = scratch(spark, "records")
    own = table(spark, sf_dir, "customer").select(F.concat_ws(":", "c_name", "c_custkey").alias("payload"))
    records.write_records(own.repartition(3), path)
    back = records.read_records(spark, path, split_bytes=1 << 16)
    return back.select(F.col("payload").cast("string").alias("payload"), F.octet_length("payload").cast("long").alias("n_bytes"))


@query(
    "point_clouds",
    """WITH v AS (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 4)) AS place FROM embeddings)
SELECT vec_id, place, round(embedding[4 * place + 1], 4) + 0e0 AS x, round(embedding[4 * place + 2], 4) + 0e0 AS y, round(embedding[4 * place + 3], 4) + 0e0 AS z, embedding[4 * place + 4] > 0 AS bright FROM v""",
)
def point_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as clouds of points: files inside checked records, read back in byte ranges and decoded."""
    path, v = scratch(spark, "clouds"), F.col("embedding").cast("array<double>")
    cloud = F.transform(F.sequence(F.lit(0), (F.size(v) / 4).cast("int") - 1), lambda i: F.slice(v, i * 4 + 1, 4))
    own = table(spark, sf_dir, "embeddings").select(F.concat(F.to_binary(F.lpad(F.hex("vec_id"), 16, "0"), F.lit("hex")), points.encoded(cloud)).alias("payload"))
    records.write_records(own, path)
    back = records.read_records(spark, path).select(F.conv(F.hex(F.substring("payload", 1, 8)), 16, 10).cast("long").alias("vec_id"), F.expr("substring(payload, 9)").alias("body"))
    found = points.read_points(back, "vec_id", "body")
    return found.select("vec_id", "place", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"], (F.col("intensity") > 0).alias("bright"))


@query(
    "camera_frames",
    """SELECT CAST(user_id AS VARCHAR) AS sequence, camera, user_id || '-' || event_id || '.jpg' AS file_name, event_type || camera AS image
FROM events, (VALUES ('front'), ('front_left'), ('front_right')) v(camera)""",
)
def camera_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with three pictures each, as messages in record files, taken apart again."""
    path = scratch(spark, "frames")
    picture = lambda k: records.delimited(4, F.concat(F.unhex(F.lit(f"08{k:02x}")), records.delimited(2, F.concat("event_type", F.lit(records.CAMERAS[k])))))
    name = records.delimited(1, records.delimited(1, F.concat_ws("-", "user_id", "event_id")))
    frame = records.delimited(1, F.concat(name, *[picture(k) for k in (1, 2, 3)]))
    records.write_records(table(spark, sf_dir, "events").select(frame.alias("payload")), path)
    found = records.camera_images(records.read_records(spark, path))
    return found.select("sequence", "camera", "file_name", F.col("image").cast("string").alias("image"))


@query("codebook_file", "SELECT CAST(n_nationkey AS INTEGER) AS token_id, round(n_nationkey / 4e0, 6) AS x FROM nation")
def codebook_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kerbline.operators import tokens

    path = scratch(spark, "codebook")
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("token_id"), tokens.corners_array(F.col("n_nationkey") / 4.0, F.lit(0.0), F.lit(0.0)).alias("corners"))
    own.write.parquet(path)
    middle = F.aggregate("corners", F.lit(0.0), lambda a, p: a + p.x) / 4
    return spark.read.parquet(path).select("token_id", r6(middle).alias("x"))


@query("feature_cache", "SELECT o_orderkey AS token FROM orders WHERE o_orderstatus <> 'P'")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("log"), F.col("o_orderkey").alias("token"), "o_totalprice")
    path = scratch(spark, "features")
    every = [builders.Builder("price", lambda d: d), builders.Builder("some", lambda d: d.where("log <> 'P'"))]
    for _ in range(2):  # tokens that are there are not built again
        builders.cache_features(own, every, path)
    return builders.usable_tokens(spark, every, path)


@query("agent_runs", "WITH {poses} SELECT token, CAST(step AS INTEGER) AS step, round(step * 0.5e0 * abs(y), 6) AS x FROM poses, (SELECT unnest([1, 2, 3, 4]) AS step)")
def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    agent = config.instantiate({"_target_": "agent.constant_velocity", "steps": 4, "dt": 0.5})
    return builders.run_agent(agent, poses(spark, sf_dir).select("token", F.abs("y").alias("speed"))).select("token", "step", r6("x").alias("x"))


@query("annotated", "SELECT o_orderkey AS token, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'said ' || o_orderpriority END AS cot_text FROM orders")
def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("prompt"))
    return builders.annotate(own, lambda c: F.concat(F.lit("said "), c), "prompt").select("token", "cot_text")


# ------------------------------------------------------------------ projections, lookups, sets
@query("history_only", "WITH {frames} SELECT log, idx, token FROM frames WHERE idx < 4")
def history_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    scene = frames(spark, sf_dir).groupBy("log").agg(F.sort_array(F.collect_list(F.struct("idx", "token"))).alias("frames"), F.sum("value").alias("anns"))
    return filters.history_only(scene, "frames", 4).select("log", F.explode("frames").alias("f")).select("log", "f.idx", "f.token")


@query("sensor_columns", "WITH {frames} SELECT token, CASE WHEN idx IN (0, 3) THEN value END AS front, event_type AS side FROM frames")
def sensor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = frames(spark, sf_dir).select("token", "idx", F.col("value").alias("front"), F.col("event_type").alias("side"), F.col("value").alias("back"))
    return filters.with_sensors(own, {"front": [0, 3], "side": True, "back": False}).drop("idx")


@query("height_layers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 45 THEN NULL WHEN l_quantity > 20 THEN 'above' ELSE 'below' END AS layer FROM lineitem")
def height_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", filters.height_layer(F.col("l_quantity"), 20.0, 45.0).alias("layer"))


@query("optional_text", "SELECT o_orderkey AS token, CASE WHEN c.c_custkey IS NULL THEN NULL WHEN c.c_custkey % 2 = 0 THEN '' ELSE c.c_name END AS reference FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey")
def optional_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).alias("cot_output"))
    return samples.with_reference_text(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token")), texts)


@query("intent_text", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'go straight' WHEN 2 THEN 'go left' WHEN 3 THEN 'go right' ELSE 'unknown' END AS instruction FROM events")
def intent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", samples.intent_text(F.col("event_id") % 6).alias("instruction"))


@query("object_union", "SELECT 'n' || n_nationkey AS track_token, NULL AS speed FROM nation UNION ALL SELECT 'c' || c_custkey, c_acctbal FROM customer UNION ALL SELECT 'red_light_' || r_regionkey, NULL FROM region")
def object_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("track_token")
    moving = table(spark, sf_dir, "customer").select(token("c", "c_custkey"), F.col("c_acctbal").alias("speed"))
    return forecast.all_objects(table(spark, sf_dir, "nation").select(token("n", "n_nationkey")), moving, table(spark, sf_dir, "region").select(token("red_light_", "r_regionkey")))


@query("field_difference", "SELECT 'fields' AS \"check\", c_custkey || '.' || f AS item FROM customer, (SELECT unnest(['a', 'b', 'c']) AS f) WHERE NOT (f = 'a' OR (f = 'b' AND c_custkey % 2 = 0))")
def field_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("present"))
    return vocabulary.missing_fields(own, "key", "present", ("a", "b", "c"), "fields")


@query(
    "prompt_lines",
    """WITH v(base, attribute, value) AS (SELECT p_type, 'brand', p_brand FROM part UNION ALL SELECT p_type, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT c_mktsegment, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT '- ' || base || '.' || attribute || ': ' || string_agg(DISTINCT value, ', ' ORDER BY value) AS line FROM v GROUP BY base, attribute""",
)
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, people = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    told = lambda rows, base, attribute, value: rows.select(F.col(base).alias("base"), F.lit(attribute).alias("attribute"), F.col(value).cast("string").alias("value"))
    values = told(parts, "p_type", "brand", "p_brand").unionByName(told(parts, "p_type", "size", "p_size")).unionByName(told(people, "c_mktsegment", "nation", "n_name"))
    return vocabulary.prompt_lines(values, "base", "attribute", "value")


@query(
    "seeded_shuffle",
    f"SELECT o_orderkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY CASE epoch WHEN 0 THEN {draws.uniform_sql(['o_orderkey'], 5, 0)} ELSE {draws.uniform_sql(['o_orderkey'], 5, 1)} END, o_orderkey) - 1 AS place FROM orders, (VALUES (0), (1)) v(epoch)",
)
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in the order of a seed, for two epochs; the second from a table that is dealt otherwise."""
    own = table(spark, sf_dir, "orders").select("o_orderkey")
    epochs = [scenes.shuffled_places(d, "o_orderkey", 5, epoch).withColumn("epoch", F.lit(epoch)) for epoch, d in enumerate((own, own.repartition(7)))]
    return epochs[0].unionByName(epochs[1])


@query("future_steps", "WITH {frames} SELECT a.log, a.idx, k AS ahead, b.token FROM frames a, (VALUES (5), (10), (15), (20), (25), (30), (35), (40)) s(k), frames b WHERE a.log = b.log AND b.idx = a.idx + k")
def future_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.future_frames(frames(spark, sf_dir), "token", "log", "idx", 4.0, 0.1, 8)


# ------------------------------------------------------------------ geometry and objects
@query(
    "ego_corner_points",
    "WITH {poses} SELECT token, round(x + 1.461e0 * cos(heading) + 2.25e0 * cos(heading) - 1 * sin(heading), 5) + 0e0 AS fx, round(y + 1.461e0 * sin(heading) + 2.25e0 * sin(heading) + 1 * cos(heading), 5) + 0e0 AS fy, round(x + 1.461e0 * cos(heading), 5) + 0e0 AS cx FROM poses",
)
def ego_corner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = geo.ego_corners(F.col("x"), F.col("y"), F.col("heading"), 4.5, 2.0, 1.461)
    r5 = lambda c: F.round(c, 5) + 0.0
    return poses(spark, sf_dir).select("token", r5(pts[0][0]).alias("fx"), r5(pts[0][1]).alias("fy"), r5(pts[4][0]).alias("cx"))


@query("two_point_rotation", "WITH {poses} SELECT token, round(atan2(sin(heading), cos(heading)), 5) + 0e0 AS angle FROM poses WHERE abs(y) > 0.01")
def two_point_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direction and the same direction turned by the heading: the rotation that aligns them is the heading."""
    a, b, h = F.col("x") + 1, F.col("y"), F.col("heading")
    angle = geo.align_two_points(a, b, a * F.cos(h) - b * F.sin(h), a * F.sin(h) + b * F.cos(h))
    return poses(spark, sf_dir).where("abs(y) > 0.01").select("token", (F.round(angle, 5) + 0.0).alias("angle"))


@query("lead_speed", "WITH {poses} SELECT token, round(CASE WHEN event_type = 'view' THEN 0 ELSE value * cos(heading - y) END, 5) + 0e0 AS speed FROM poses")
def lead_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = classify.lead_velocity(F.col("value"), F.col("heading"), F.col("y"), F.col("event_type") == "view")
    return poses(spark, sf_dir).select("token", (F.round(v, 5) + 0.0).alias("speed"))


@query("local_rings", "WITH {poses} SELECT token, round((3 - p.x) * cos(heading) + (1 - p.y) * sin(heading), 5) + 0e0 AS rx, round((1 - p.y) * cos(heading) - (3 - p.x) * sin(heading), 5) + 0e0 AS ry FROM poses p")
def local_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = geo.ring_to_local(F.array(F.struct(F.lit(3.0).alias("x"), F.lit(1.0).alias("y"))), F.col("x"), F.col("y"), F.col("heading"))
    return poses(spark, sf_dir).select("token", (F.round(F.get(ring, F.lit(0)).x, 5) + 0.0).alias("rx"), (F.round(F.get(ring, F.lit(0)).y, 5) + 0.0).alias("ry"))


@query(
    "typed_tracks",
    """WITH {poses} SELECT token, 'k' || token AS track_token, CASE event_type WHEN 'view' THEN 'barrier' ELSE 'vehicle' END AS type, CASE WHEN event_type <> 'view' THEN round(value * cos(heading) - y * sin(heading), 4) + 0e0 END AS vx FROM poses""",
)
def typed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir)
    anns = F.struct(
        F.array(F.array("x", "y")).alias("gt_boxes"), F.array("event_type").alias("gt_names"), F.array(F.array("value", "y")).alias("gt_velocity_3d"),
        F.array(F.col("token").cast("string")).alias("instance_tokens"), F.array(F.concat(F.lit("k"), "token")).alias("track_tokens"),
    )
    long = logs.annotations_long(own.select(F.col("log").cast("string").alias("log_name"), "token", F.col("idx").alias("frame_idx"), anns.alias("anns")))
    name = F.col("event_type").alias("name")
    kinds = own.select(name).distinct().select("name", F.when(F.col("name") == "view", "barrier").otherwise("vehicle").alias("type"), (F.col("name") != "view").alias("is_agent"))
    return logs.typed_tracks(long, kinds, own.select("token", "heading")).select("token", "track_token", "type", (F.round("vx", 4) + 0.0).alias("vx"))


@query("initial_hits", "WITH {frames} SELECT DISTINCT log AS scene, CASE WHEN token % 3 = 0 THEN 'red_light_' ELSE 'o' END || token AS track_token FROM frames WHERE idx = 0 AND (token % 3 <> 0 OR value > 50)")
def initial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.when(F.col("token") % 3 == 0, "red_light_").otherwise("o"), F.col("token").cast("string"))
    pairs = frames(spark, sf_dir).select(F.col("log").alias("scene"), F.col("idx").alias("t"), token.alias("track_token"), "value")
    return forecast.initially_hit(pairs, F.col("value") > 50, "scene")


@query(
    "recorded_objects",
    "WITH {poses}, o AS (SELECT log, idx AS t, 'o' || idx % 3 AS track_token, event_type, x FROM poses), l AS (SELECT log FROM o GROUP BY log HAVING max(t) >= 5), f AS (SELECT log, track_token, arg_min(event_type, t) AS type FROM o GROUP BY ALL) SELECT o.log AS scene, o.t, o.track_token, f.type, round(o.x, 6) AS x FROM o JOIN l USING (log) JOIN f ON f.log = o.log AND f.track_token = o.track_token WHERE o.t <= 5",
)
def recorded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = poses(spark, sf_dir).select(F.col("log").alias("scene"), F.col("idx").alias("t"), F.concat(F.lit("o"), (F.col("idx") % 3).cast("string")).alias("track_token"), F.col("event_type").alias("type"), "x")
    whole = own.join(own.groupBy("scene").agg(F.max("t").alias("last")).where("last >= 5").select("scene"), "scene", "left_semi")
    return forecast.recorded_occupancy(whole, "scene", 5).select("scene", "t", "track_token", "type", r6("x").alias("x"))


# ------------------------------------------------------------------ lanes and routes
@query(
    "centerline_points",
    """WITH l AS (SELECT n_nationkey AS lane_id, n_regionkey AS pos FROM nation), p AS (SELECT lane_id, pos, i AS idx, lane_id + i / 10e0 AS x FROM l, range(0, 4) r(i)), s AS (SELECT c_custkey AS token, c_custkey % 3 AS start_pos FROM customer)
SELECT token, row_number() OVER (PARTITION BY token ORDER BY pos, lane_id, idx) - 1 AS s_idx, round(x, 6) AS x FROM s JOIN p ON pos >= start_pos AND pos < start_pos + 30""",
)
def centerline_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer drives the nations in the order of region and key, from a region of its own on."""
    lanes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("lane_id"), (F.col("n_regionkey") + F.col("n_nationkey") / 100).alias("pos"))
    token = F.col("c_custkey").alias("token")
    own = table(spark, sf_dir, "customer")
    points = lanes.select("lane_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx")).select("lane_id", "idx", (F.col("lane_id") + F.col("idx") / 10.0).alias("x"), F.lit(0.0).alias("y"))
    found = graph.centerline(own.select(token).join(F.broadcast(lanes)), own.select(token, (F.col("c_custkey") % 3).alias("start_pos")), points)
    return found.select("token", F.col("s_idx").cast("long").alias("s_idx"), r6("x").alias("x"))


def _roads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A road of eight blocks of two lanes for each customer; lanes go on straight, and to the other lane at every third block."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("token"), "c_custkey")
    lane = lambda b, k: F.concat(F.lit("l"), b.cast("string"), F.lit("_"), k.cast("string"))
    cells = own.select("token", "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("b")).select("token", "c_custkey", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    length = 10.0 + F.pmod(F.col("c_custkey") * 7 + F.col("b") * 3 + F.col("k") * 5, F.lit(11))
    lanes = cells.select("token", lane(F.col("b"), F.col("k")).alias("lane_id"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("roadblock_id"), length.alias("length"))
    ahead = cells.where("b < 7").withColumn("k2", F.explode(F.when(F.col("b") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array("k"))))
    return lanes, ahead.select("token", lane(F.col("b"), F.col("k")).alias("src"), lane(F.col("b") + 1, F.col("k2")).alias("dst"))


@query(
    "lane_paths",
    """WITH RECURSIVE l AS (SELECT c_custkey AS token, b, k, 10e0 + (c_custkey * 7 + b * 3 + k * 5) % 11 AS length FROM customer, range(0, 8) x(b), range(0, 2) y(k)),
r AS (SELECT c_custkey AS token, 0 AS b, 0 AS k, 1e0 AS cost, 1 AS n FROM customer UNION ALL
SELECT r.token, l.b, l.k, r.cost + l.length, r.n + 1 FROM r JOIN l ON l.token = r.token AND l.b = r.b + 1 AND (r.b % 3 = 0 OR l.k = r.k))
SELECT CAST(token AS VARCHAR) AS token, CAST(max(n) AS INTEGER) AS n, min(cost) AS cost, true AS found FROM r WHERE b = 7 GROUP BY token""",
)
def lane_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest way along each road: its lanes, and what they cost (the first lane costs 1)."""
    lanes, edges = _roads(spark, sf_dir)
    asked = lanes.select("token").distinct().select("token", F.lit("l0_0").alias("start_lane"), F.lit("b7").alias("goal_block"))
    paths = graph.lane_paths(asked, lanes, edges)
    return paths.where(F.size("lanes") > 0).select("token", F.size("lanes").alias("n"), "cost", "found")


@query("route_repair", "SELECT CAST(c_custkey AS VARCHAR) AS token, CASE WHEN c_custkey % 3 = 0 THEN 'b0 b1 b2 b3 b4 b5 b6' WHEN c_custkey % 3 = 1 THEN 'b0 b1 b2 b3 b4 b5 b6' ELSE 'b2 b3 b4 b5 b6' END AS blocks FROM customer")
def route_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that begin beyond the vehicle, that lack blocks, and that go in a loop."""
    own, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    token = key.cast("string").alias("token")
    words = lambda t: F.array(*[F.lit(x) for x in t.split(" ")])
    blocks = F.when(key % 3 == 0, words("b3 b4 b5 b6")).when(key % 3 == 1, words("b0 b2 b5 b6")).otherwise(words("b2 b3 b4 b3 b4 b5 b6"))
    routes = own.select(token, F.when(key % 3 == 2, "b2").otherwise("b0").alias("start"), blocks.alias("blocks"))
    edges = own.select(token, F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b")).select("token", F.concat(F.lit("b"), "b").alias("src"), F.concat(F.lit("b"), F.col("b") + 1).alias("dst"))
    back = own.select(token, F.lit("b4").alias("src"), F.lit("b3").alias("dst"))
    return graph.repair_routes(routes, edges.unionByName(back)).select("token", F.array_join("blocks", " ").alias("blocks"))


# ------------------------------------------------------------------ the planner
def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).where("idx = 0").select(
        "token", (F.abs("y") * 10).alias("speed"), F.col("heading").alias("accel"), F.lit(None).cast("double").alias("limit"), (F.col("value") + 10).alias("lead_gap"), F.abs("heading").alias("lead_speed")
    )


@query(
    "ttc_fold",
    """WITH c AS (SELECT l_suppkey AS proposal, CASE WHEN l_partkey % 17 = 0 THEN 'red_light_' ELSE 'o' END || l_partkey % 50 AS object, CAST(l_linenumber AS INTEGER) AS t, CAST(3 * (l_orderkey % 4) AS INTEGER) AS ahead, l_discount AS speed, l_returnflag = 'N' AS in_front, l_linestatus = 'F' AND l_suppkey % 5 = 0 AS hit FROM lineitem),
k AS (SELECT *, t * 100 + ahead AS o FROM c WHERE NOT starts_with(object, 'red_light') AND NOT hit AND speed >= 0.005e0),
f AS (SELECT *, min(CASE WHEN NOT in_front THEN o END) OVER (PARTITION BY proposal, object) AS clean FROM k),
g AS (SELECT proposal, min(CASE WHEN in_front AND (clean IS NULL OR o < clean) THEN t END) AS first FROM f GROUP BY proposal)
SELECT p.proposal, CASE WHEN first IS NULL THEN 1e0 ELSE 0e0 END AS ttc, round(first * 0.1e0, 6) AS first_time FROM (SELECT DISTINCT proposal FROM c) p LEFT JOIN g ON g.proposal = p.proposal""",
)
def ttc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    object_ = F.concat(F.when(F.col("l_partkey") % 17 == 0, "red_light_").otherwise("o"), (F.col("l_partkey") % 50).cast("string"))
    contacts = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("proposal"), object_.alias("object"), F.col("l_linenumber").alias("t"), (3 * (F.col("l_orderkey") % 4)).cast("int").alias("ahead"), F.col("l_discount").alias("speed"),
        (F.col("l_returnflag") == "N").alias("in_front"), ((F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 5 == 0)).alias("initially_hit"),
    )
    found = planner.ttc_fold(contacts, ["proposal"])
    return found.select("proposal", "ttc", F.when(F.col("first_time") < float("inf"), F.round("first_time", 6)).alias("first_time"))


@query(
    "brake_path",
    """WITH {poses}, s AS (SELECT token, x, y, heading AS h, abs(y) * 10 AS v, heading AS a FROM poses WHERE idx = 0),
b AS (SELECT *, CASE WHEN v > 0.2e0 THEN 1.1e0 * (v + greatest(least(-10 * v, 2.4e0), -4.05e0)) ELSE greatest(least(-4 * v - a, 2.4e0), -4.05e0) END AS c FROM s)
SELECT token, CAST(t AS INTEGER) AS t, round(x + c * t * 0.1e0 * cos(h), 5) + 0e0 AS x, round(y + c * t * 0.1e0 * sin(h), 5) + 0e0 AS y FROM b, range(0, 41) r(t)""",
)
def brake_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = poses(spark, sf_dir).where("idx = 0").select("token", "x", "y", "heading", (F.abs("y") * 10).alias("speed"), F.col("heading").alias("accel"))
    r5 = lambda c: F.round(c, 5) + 0.0
    return planner.brake_path(starts).select("token", "t", r5("x").alias("x"), r5("y").alias("y"))


_IDM_SQL = """{poses}, s AS (SELECT token, abs(y) * 10 AS v, value + 10 AS gap, abs(heading) AS lead FROM poses WHERE idx = 0),
g AS (SELECT s.*, f / 5e0 * 15 AS target, CAST(l * 5 + f - 1 AS INTEGER) AS proposal, l - 1e0 AS lat FROM s, range(0, 3) a(l), range(1, 6) b(f)),
r AS (SELECT token, proposal, lat, target, lead, 0 AS t, 0e0 AS s, v, gap FROM g UNION ALL
SELECT token, proposal, lat, target, lead, t + 1, s + v * 0.1e0, greatest(v + 0.1e0 * greatest(least(1.5e0 * (1 - power(v / target, 10) - power(greatest(1 + v * 1.5e0 + v * (v - lead) / (2 * sqrt(4.5e0)), 0) / greatest(gap, 1), 2)), 1.5e0), -3), 0), gap + (lead - v) * 0.1e0 FROM r WHERE t < {steps})"""


@query("unroll_proposals", f"WITH RECURSIVE {_IDM_SQL.replace('{steps}', '40')} SELECT token, proposal, CAST(t AS INTEGER) AS t, round(s, 4) + 0e0 AS s, lat AS \"offset\", round(v, 4) + 0e0 AS speed FROM r WHERE t > 0")
def unroll_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = planning.unroll_proposals(_starts(spark, sf_dir))
    return done.select("token", "proposal", "t", (F.round("s", 4) + 0.0).alias("s"), "offset", (F.round("speed", 4) + 0.0).alias("speed"))


@query("winner_extension", f"WITH RECURSIVE {_IDM_SQL.replace('{steps}', '50')} SELECT token, proposal, CAST(t AS INTEGER) AS t, round(s, 4) + 0e0 AS s FROM r WHERE t > 40 AND proposal = token % 15")
def winner_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _starts(spark, sf_dir)
    winners = starts.select("token", (F.col("token") % 15).cast("int").alias("proposal"))
    return planner.extended(starts, winners).select("token", "proposal", "t", (F.round("s", 4) + 0.0).alias("s"))


@query("reference_planner")
def reference_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.plan(_starts(spark, sf_dir))


_SCHEMES = {
    "topk_prob": ("-logit", "logit"),
    "topk_prob_sampled_with_dist": ("-logit", "coalesce(-distance, logit)"),
    "topk_dist_sampled_with_prob": ("-coalesce(-distance, logit)", "logit"),
}
_DRAWN = "own AS (SELECT o_custkey, o_orderkey, o_totalprice / 100000 AS logit, CASE WHEN o_custkey % 4 <> 0 THEN (o_orderkey % 97) / 10e0 END AS distance FROM orders)"


@query(
    "sampling_schemes",
    f"WITH {_DRAWN}"
    + " UNION ALL ".join(
        f""" SELECT '{name}' AS scheme, o_custkey, o_orderkey FROM (SELECT *, {weight} / 0.5e0 + {draws.gumbel_sql(["o_custkey", "o_orderkey"], 1)} AS g FROM own
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {first}, o_orderkey) <= 5) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY g DESC, o_orderkey DESC) = 1"""
        for name, (first, weight) in _SCHEMES.items()
    ),
)
def sampling_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row drawn for each group by each scheme, from among the k that the scheme allows."""
    own = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 100000).alias("logit"), F.when(F.col("o_custkey") % 4 != 0, (F.col("o_orderkey") % 97) / 10.0).alias("distance"))
    found = [filters.sampled_token(own, "o_custkey", "logit", "distance", "o_orderkey", 5, 0.5, 1, scheme).withColumn("scheme", F.lit(scheme)) for scheme in _SCHEMES]
    return found[0].unionByName(found[1]).unionByName(found[2])


_DX, _DY = draws.normal_pair_sql(["o_custkey", "o_orderkey"], 4, 1)


@query(
    "mixture_tokens",
    f"""WITH drawn AS (SELECT o_custkey, o_orderkey, o_orderkey % 25 AS mx FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 100000 + {draws.gumbel_sql(["o_custkey", "o_orderkey"], 4)} DESC, o_orderkey DESC) = 1),
placed AS (SELECT o_custkey, mx + 0.3e0 * {_DX} AS px, 0.3e0 * {_DY} AS py FROM drawn),
near AS (SELECT o_custkey, n_nationkey, sqrt(power(n_nationkey - px, 2) + power(py, 2)) AS d FROM placed, nation)
SELECT o_custkey, CAST(n_nationkey AS INTEGER) AS token_id FROM near QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d, n_nationkey) = 1""",
)
def mixture_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codebook word nearest to a place drawn from each group's mixture."""
    modes = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("mode"), (F.col("o_totalprice") / 100000).alias("logit"), (F.col("o_orderkey") % 25).cast("double").alias("mx"), F.lit(0.0).alias("my"), F.lit(0.3).alias("spread"))
    words = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("token_id"), F.col("n_nationkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    return filters.sampled_from_mixture(modes, words, "o_custkey", 4)


class _Flaky:
    """Answers a prompt from the attempt on that its number asks for, never at once."""

    def __init__(self, asks: int):
        self.asks, self.seen = asks, {}

    def __call__(self, prompts: list[str]) -> list[str]:
        for p in prompts:
            self.seen[p] = self.seen.get(p, 0) + 1
        if len(prompts) > 1:
            raise ConnectionError("too many at once")
        if self.seen[prompts[0]] < max(2, int(prompts[0]) % self.asks + 1):
            raise TimeoutError(f"no answer to {prompts[0]}")
        return [f"text {prompts[0]}"]


@builders.backend("flaky")
def _flaky(asks: int = 5) -> _Flaky:
    return _Flaky(asks)


@query(
    "retried",
    """SELECT o_orderkey AS token, CASE WHEN o_orderkey % 5 <= 2 THEN 'text ' || o_orderkey ELSE '' END AS cot_text, CAST(CASE WHEN o_orderkey % 5 <= 1 THEN 2 ELSE 3 END AS INTEGER) AS attempts,
CASE WHEN o_orderkey % 5 > 2 THEN 'TimeoutError: no answer to ' || o_orderkey END AS error FROM orders""",
)
def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that fails on batches and then by the prompt's number; waits are left out.  Batches hold several prompts."""
    prompts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_orderkey").cast("string").alias("prompt"))
    found = builders.annotate_with_retries(prompts.repartition(4), "flaky", "prompt", batch=2, retries=3, sleep=_no_wait, asks=5)
    return found.select("token", "cot_text", "attempts", "error")


def _no_wait(seconds: float) -> None:
    pass


@query(
    "nested_paths",
    """WITH o AS (SELECT o_orderkey AS token, o_orderstatus AS status, o_orderpriority AS priority, o_custkey AS customer, o_custkey % 4 AS n FROM orders)
SELECT token, '$' AS path, 'object' AS type, NULL AS value FROM o
UNION ALL SELECT token, '$.customer', 'number', CAST(customer AS VARCHAR) FROM o
UNION ALL SELECT token, '$.state', 'object', NULL FROM o
UNION ALL SELECT token, '$.state.open', 'boolean', CAST(status = 'O' AS VARCHAR) FROM o
UNION ALL SELECT token, '$.state.words', 'array', NULL FROM o
UNION ALL SELECT token, '$.state.words[0]', 'string', priority FROM o
UNION ALL SELECT token, '$.state.words[1]', CASE WHEN status = 'F' THEN 'null' ELSE 'string' END, CASE WHEN status <> 'F' THEN status END FROM o
UNION ALL SELECT token, '$.objects', 'array', NULL FROM o
UNION ALL SELECT token, '$.objects[' || i || ']', 'object', NULL FROM o, range(0, n) r(i)
UNION ALL SELECT token, '$.objects[' || i || '].id', 'number', CAST(i AS VARCHAR) FROM o, range(0, n) r(i)""",
)
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene documents with objects beside their state, every value by its path and type."""
    objects = F.transform(F.when(F.col("o_custkey") % 4 > 0, F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 4 - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("id")))
    words = F.array("o_orderpriority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    state = F.struct((F.col("o_orderstatus") == "O").alias("open"), words.alias("words"))
    scenes_as_text = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.to_json(F.struct(F.col("o_custkey").alias("customer"), state.alias("state"), objects.alias("objects"))).alias("text"))
    return nested.walked(nested.parsed(scenes_as_text, "text"), "token", deepest=4)
