"""Lane and roadblock graphs: breadth-first reach, shortest lane paths, route repair."""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import cut


def reach(edges: DataFrame, sources: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(source, node, depth): all nodes within `depth` edges of each source, by levels.

    edges: (src, dst); sources: (source).  One equi-join a level on what the last level added.
    """
    step = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if backward else edges
    step = step.select("src", "dst").distinct()
    seen = sources.select("source", F.col("source").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        more = front.join(step, front.node == step.src).select("source", F.col("dst").alias("node")).distinct()
        front = cut(more.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def shortest_hops(edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """(source, target, hops) of each asked pair; hops is null where the target is not within `depth`."""
    found = reach(edges, pairs.select("source").distinct(), depth)
    return pairs.join(found.select("source", F.col("node").alias("target"), F.col("depth").alias("hops")), ["source", "target"], "left")


def _lane_path(lanes: dict, out: dict, start: str, goal_block: str) -> tuple[list, bool]:
    """Cheapest path from a lane to the first lane of the goal block; else the deepest path, the cheapest of those."""
    counter = 0
    queue = [(1.0, counter, start)]
    best, parent, depth, done = {start: 1.0}, {start: None}, {start: 0}, set()
    goal = None
    while queue:
        cost, _, lane = heapq.heappop(queue)
        if lane in done:
            continue
        done.add(lane)
        if lanes[lane][0] == goal_block:
            goal = lane
            break
        for other in out.get(lane, ()):
            if other in lanes and other not in done and cost + lanes[other][1] < best.get(other, float("inf")):
                counter += 1
                best[other], parent[other], depth[other] = cost + lanes[other][1], lane, depth[lane] + 1
                heapq.heappush(queue, (best[other], counter, other))
    end = goal if goal is not None else min(done, key=lambda x: (-depth[x], best[x], str(x)))
    path, at = [], end
    while at is not None:
        path.append(at)
        at = parent[at]
    return path[::-1], goal is not None


def _by_token(*parts: DataFrame) -> DataFrame:
    """(token, p0, p1, ...): the rows of each part as an array of structs of its other columns, one row a token; one exchange of small rows, whatever sizes the parts are taken for."""
    names = [[c for c in p.columns if c != "token"] for p in parts]
    kinds = ["struct<" + ", ".join(f"{c}: {k}" for c, k in p.dtypes if c != "token") + ">" for p in parts]
    own = [p.select("token", *[F.struct(*names[i]).alias(f"p{i}") if i == k else F.lit(None).cast(kinds[k]).alias(f"p{k}") for k in range(len(parts))]) for i, p in enumerate(parts)]
    return functools.reduce(DataFrame.unionByName, own).groupBy("token").agg(*[F.collect_list(f"p{k}").alias(f"p{k}") for k in range(len(parts))])


def _edges_out(edges: list) -> dict:
    out: dict = {}
    for src, dst in sorted((e["src"], e["dst"]) for e in edges if e["src"] is not None and e["dst"] is not None):
        out.setdefault(src, []).append(dst)
    return out


def lane_paths(asked: DataFrame, lanes: DataFrame, edges: DataFrame) -> DataFrame:
    """(token, lanes, found, cost): one search per token over the lanes of its own route; the cost counts the first lane as 1.

    asked: (token, start_lane, goal_block); lanes: (token, lane_id, roadblock_id, length); edges: (token, src, dst).
    A token's route has a bounded number of lanes, so a group fits a task; a batch holds many tokens.
    """

    def run(batches):
        for batch in batches:
            rows: dict = {"token": [], "lanes": [], "found": [], "cost": []}
            for r in batch.to_pylist():
                if not r["p0"] or not (r["p1"] or r["p2"]):
                    continue
                ask = r["p0"][0]
                known = {e["lane_id"]: (e["roadblock_id"], e["length"]) for e in r["p1"]}
                path, found = _lane_path(known, _edges_out(r["p2"]), ask["start_lane"], ask["goal_block"]) if ask["start_lane"] in known else ([], False)
                for k, v in zip(rows, (r["token"], path, found, sum((known[x][1] for x in path[1:]), 1.0) if path else None), strict=True):
                    rows[k].append(v)
            token = pa.array(rows["token"], batch.schema.field("token").type)
            yield pa.RecordBatch.from_arrays([token, pa.array(rows["lanes"], pa.list_(pa.string())), pa.array(rows["found"], pa.bool_()), pa.array(rows["cost"], pa.float64())], list(rows))

    kind = dict(asked.dtypes)["token"]
    parts = _by_token(asked.select("token", "start_lane", "goal_block"), lanes.select("token", "lane_id", "roadblock_id", F.col("length").cast("double").alias("length")), edges.select("token", "src", "dst"))
    return parts.mapInArrow(run, f"token {kind}, lanes array<string>, found boolean, cost double")


def lanes_of_route(route: DataFrame, lanes: DataFrame) -> DataFrame:
    """(token, pos, lane_id): each roadblock of a route once, at its first place, with its lanes."""
    once = route.groupBy("token", "roadblock_id").agg(F.min("pos").alias("pos"))
    return once.join(lanes.select("lane_id", "roadblock_id"), "roadblock_id").select("token", "pos", "lane_id")


def centerline(route: DataFrame, start: DataFrame, points: DataFrame, window: int = 30) -> DataFrame:
    """(token, s_idx, x, y): points of the lanes from the start block on, `window` blocks at most, end to end.

    route: (token, pos, lane_id); start: (token, start_pos); points: (lane_id, idx, x, y).
    """
    ahead = route.join(start, "token").where((F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("start_pos") + window))
    w = Window.partitionBy("token").orderBy("pos", "idx")
    return ahead.join(points, "lane_id").select("token", (F.row_number().over(w) - 1).alias("s_idx"), "x", "y")


def repaired_route(route: list, out: dict, back_depth: int = 15, link_depth: int = 30, start: str | None = None) -> list:
    """Route of one token made whole: a way to it put before, missing links put in, loops cut out."""

    def bfs(a: str, goals: set, depth: int) -> list | None:
        queue, seen = [[a]], {a}
        while queue:
            path = queue.pop(0)
            if path[-1] in goals:
                return path
            if len(path) <= depth:
                for n in out.get(path[-1], ()):
                    if n not in seen:
                        seen.add(n)
                        queue.append([*path, n])
        return None

    whole = list(route)
    if start is not None and whole and start not in whole:
        way = bfs(start, {whole[0]}, back_depth) or bfs(start, set(whole[:3]), link_depth)
        if way:
            whole = [*way[:-1], *whole[whole.index(way[-1]) :]]
    linked = whole[:1]
    for b in whole[1:]:
        if b in out.get(linked[-1], ()):
            linked.append(b)
        else:
            way = bfs(linked[-1], {b}, link_depth)
            linked += way[1:] if way else [b]
    clean: list = []
    for b in linked:
        if b in clean:
            clean = clean[: clean.index(b)]
        clean.append(b)
    return clean


def repair_routes(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """routes: (token, start, blocks array); edges: (token, src, dst) near the route.  Returns (token, blocks)."""

    def run(batches):
        for batch in batches:
            token, blocks = [], []
            for r in batch.to_pylist():
                out = _edges_out(r["p1"]) if r["p0"] else {}
                for route in r["p0"]:
                    token.append(r["token"])
                    blocks.append(repaired_route(route["blocks"], out, start=route["start"]))
            yield pa.RecordBatch.from_arrays([pa.array(token, batch.schema.field("token").type), pa.array(blocks, pa.list_(pa.string()))], ["token", "blocks"])

    kind = dict(routes.dtypes)["token"]
    return _by_token(routes.select("token", "start", "blocks"), edges.select("token", "src", "dst")).mapInArrow(run, f"token {kind}, blocks array<string>")


def convex_overlap(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> float:
    """Area that two convex rings (anticlockwise) share: one is clipped by each edge of the other."""
    left = list(a)
    for (x0, y0), (x1, y1) in zip(b, b[1:] + b[:1], strict=True):
        side = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in left]
        kept = []
        for i, p in enumerate(left):
            q, s, t = left[(i + 1) % len(left)], side[i], side[(i + 1) % len(left)]
            if s >= 0:
                kept.append(p)
            if s * t < 0:
                u = s / (s - t)
                kept.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
        left = kept
        if not left:
            return 0.0
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(left, left[1:] + left[:1], strict=True))) / 2


def first_loop(rings: list[list[tuple[float, float]]], limit: float = 1.0) -> int | None:
    """Place of the first block that covers more than `limit` of an earlier one's area; None if none does."""
    for k, ring in enumerate(rings):
        if any(convex_overlap(ring, other) > limit for other in rings[:k]):
            return k
    return None


def search_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_depth: int, backward: bool = False) -> DataFrame:
    """(token, path, found): breadth-first search from the start of each token to the first of its goals.

    edges: src, dst, place (the order of a block's neighbours); starts: token, start; goals: token, goal, any number.
    Nodes are met level by level in the order of a queue that holds a node once for each way to it.  The goal that is met
    first within max_depth levels (the start is the first) wins; where there is none, the path leads to the node that
    would have been queued last.  A path follows, level by level, the way that was queued last.

    A level keeps each node once, with its first and last place in the queue, which is all that decides; so levels stay
    as small as the graph although queues would not.  One join a level; tokens that have arrived leave.
    """
    step = edges.select(F.col("dst" if backward else "src").alias("at"), F.col("src" if backward else "dst").alias("to"), "place")
    wanted = goals.select(F.col("token").alias("for"), F.col("goal").alias("node"), F.lit(True).alias("wanted")).distinct()
    by_first, by_last = Window.partitionBy("token").orderBy("first"), Window.partitionBy("token").orderBy("last")
    front = cut(starts.select("token", F.col("start").alias("node"), F.lit(1).alias("first"), F.lit(1).alias("last"), F.array("start").alias("path")))
    arrived, ends = [], [front.select("token", "path", F.lit(1).alias("depth"), "last")]
    for depth in range(1, max_depth + 1):
        met = front.join(wanted, (front.token == F.col("for")) & (front.node == wanted.node)).groupBy("token").agg(F.min_by("path", "first").alias("path"))
        arrived.append(cut(met))
        going = front.join(arrived[-1].select("token"), "token", "left_anti")
        more = going.join(step, F.col("node") == F.col("at")).groupBy("token", "to").agg(
            F.min(F.struct("first", "place", "to")).alias("first"),
            F.max(F.struct("last", "place", "to")).alias("last"),
            F.max_by("path", F.struct("last", "place")).alias("path"),
        )
        front = cut(more.select("token", F.col("to").alias("node"), F.row_number().over(by_first).alias("first"), F.row_number().over(by_last).alias("last"), F.concat("path", F.array("to")).alias("path")))
        ends.append(front.select("token", "path", F.lit(depth + 1).alias("depth"), "last"))
        if front.isEmpty():
            break
    found = functools.reduce(DataFrame.unionByName, arrived)
    deepest = functools.reduce(DataFrame.unionByName, ends).groupBy("token").agg(F.max_by("path", F.struct("depth", "last")).alias("deepest"))
    known = found.select(F.col("token").alias("for"), F.col("path").alias("there"))
    return deepest.join(known, F.col("token") == F.col("for"), "left").select("token", F.coalesce("there", "deepest").alias("path"), F.col("there").isNotNull().alias("found"))
