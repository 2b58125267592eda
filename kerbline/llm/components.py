"""Connected components of a graph kept in a table, by alternating large-star and small-star rounds.

Each task first contracts the edges it holds to a spanning forest, a bounded run of them at a time, so the rounds
over the whole graph begin with little more than the nodes.  A forest that is small then, by its count, is folded by one
task; a larger one goes through the rounds, with the same result.  What a round leaves behind is let go at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, shuffle_partitions

#: Edges that a task contracts at a time.
RUN_EDGES = 500_000
#: Edges, two numbers each, up to which one task folds what is left.
FOLD_EDGES = 2_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): a star for each component of the edges, around its smallest node."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            out = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[out], nodes[label[out]]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _contract(stream):
    us, vs, held = [], [], 0

    def flush():
        node, root = forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_pydict({"u": pa.array(node, pa.int64()), "v": pa.array(root, pa.int64())})

    for batch in stream:
        us.append(batch["u"].to_numpy())
        vs.append(batch["v"].to_numpy())
        held += batch.num_rows
        if held >= RUN_EDGES:
            yield flush()
            us, vs, held = [], [], 0
    if held:
        yield flush()


def _fold(stream):
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in stream if b.num_rows]
    if parts:
        node, root = forest(np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts]))
        top = np.unique(root)
        yield pa.RecordBatch.from_pydict({"node": pa.array(np.concatenate([node, top]), pa.int64()), "root": pa.array(np.concatenate([root, top]), pa.int64())})


def _nearest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node and its neighbours.  Written out, so that the join back is between two
    plain exchanges and a node with very many neighbours can be split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("m")))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of longs.  Returns (node, root): root is the smallest node of the component; only nodes that have an edge."""
    spark = edges.sparkSession
    edges = cut(edges.select("u", "v").coalesce(shuffle_partitions(spark)).mapInArrow(_contract, "u long, v long"))
    if edges.count() <= FOLD_EDGES:
        return cut(edges.coalesce(1).mapInArrow(_fold, "node long, root long"))
    seen = None
    while True:
        # what a round leaves is a star around each root once nothing changes
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _nearest(both)
        # larger neighbours of a node hang on the smallest one
        large = cut(both.join(near, both.u == near.node).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"))
        # smaller neighbours and the node itself hang on the smallest one
        near = _nearest(large)
        joined = large.join(near, large.u == near.node)
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionAll(near.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u != v").distinct())
        del both, near, large, joined, small
        release(spark)
