"""Operator 6: approximate nearest neighbours by collision counting with query-aware windows.

Every candidate chunk keeps, for each of PROJECTIONS random directions, its rows sorted by their projection.
A query opens a window around its own projection on each line; a row collides where it lies in the window.
Virtual rehashing widens all windows together; rows that collide on THRESHOLD of the lines are verified with
their true distance.  Widening stops when a row as near as the k-th best found so far would have reached the
threshold with probability CERTAIN, or when all rows are verified, so there is no cap on candidates.

All rows are indexed; the directions are fixed by a seed, nothing is fitted.

Edge cases: rows without an id and vectors that are null, zero, of another length than most or hold null or non-finite components
take no part; a query never finds its own row, but finds other rows with its id; ties go to the smaller id;
fewer candidates than k give all of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import FOUND, finite_vectors, search

#: Lines per chunk, and the share of them on which a row must collide to be verified.
PROJECTIONS, THRESHOLD = 96, 0.6
#: Chance that a row as near as the k-th best has been verified when the search stops.
CERTAIN = 0.975
#: Each rehashing widens the windows by this factor.
WIDEN = 1.2
_SEED = 7


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((dim, PROJECTIONS))


def _build(ids: np.ndarray, vectors: list[list[float]], asks: bool) -> bytes:
    v = np.array(vectors, np.float64)
    lines = (v @ _directions(v.shape[1])).T
    if asks:
        return pickle.dumps((ids, v, np.ascontiguousarray(lines.T)))
    order = np.argsort(lines, axis=1)
    # the sorted lines end to end, each moved beyond the one before, so that one search serves all
    low, high = float(lines.min()) - 1, float(lines.max()) + 1
    shift = np.arange(PROJECTIONS) * (high - low + 1) - low
    flat = (np.take_along_axis(lines, order, 1) + shift[:, None]).ravel()
    return pickle.dumps((ids, v, flat, order.astype(np.int32).ravel(), low, high, shift, float(lines.std())))


def _answer(k: int):
    need = math.ceil(THRESHOLD * PROJECTIONS)
    # share of lines on which a row must be expected to collide so that it reaches the threshold with probability CERTAIN
    share = THRESHOLD + NormalDist().inv_cdf(CERTAIN) * math.sqrt(THRESHOLD * (1 - THRESHOLD) / PROJECTIONS)
    reach = NormalDist().inv_cdf((1 + share) / 2)  # window half-width over distance at which it is

    def answer(ask: bytes, have: bytes) -> np.ndarray:
        q_ids, q_vec, q_line = pickle.loads(ask)
        ids, vec, flat, order, low, high, shift, spread = pickle.loads(have)
        n, out = len(ids), []
        for i in range(len(q_ids)):
            at = q_line[i]
            skip = -1
            lo, hi = np.searchsorted(ids, (q_ids[i], q_ids[i] + 1))
            for j in range(lo, hi):
                if np.array_equal(vec[j], q_vec[i]):
                    skip = j
                    break
            total = n - (skip >= 0)
            hits = np.zeros(n, np.int64)
            done = np.zeros(n, bool)
            if skip >= 0:
                done[skip] = True
            left = np.searchsorted(flat, np.clip(at, low, high) + shift)
            right = left
            width = 0.5 * spread or 1.0
            rows, dist = [], []
            best = np.inf
            while True:
                a = np.minimum(np.searchsorted(flat, np.clip(at - width, low, high) + shift), left)
                b = np.maximum(np.searchsorted(flat, np.clip(at + width, low, high) + shift, "right"), right)
                begin, size = np.concatenate([a, right]), np.concatenate([left - a, b - right])
                ends = np.cumsum(size)
                hits += np.bincount(order[np.arange(ends[-1]) + np.repeat(begin - ends + size, size)], minlength=n)
                left, right = a, b
                new = np.flatnonzero((hits >= need) & ~done)
                if len(new):
                    done[new] = True
                    rows.append(new)
                    dist.append(np.sqrt(((vec[new] - q_vec[i]) ** 2).sum(axis=1)))
                    every = np.concatenate(dist)
                    if len(every) >= k:
                        best = np.partition(every, k - 1)[k - 1]
                if sum(map(len, rows)) >= total or width >= reach * best:
                    break
                width = max(width * WIDEN, 1e-300)
                if best < np.inf:
                    width = min(width, max(reach * best, width / WIDEN)) if reach * best > width / WIDEN else width
            found = np.empty(sum(map(len, rows)), FOUND)
            found["place"], found["query"], found["score"] = i, q_ids[i], 0
            if rows:
                found["id"], found["measure"] = ids[np.concatenate(rows)], np.concatenate(dist)
            out.append(found[np.lexsort((found["id"], found["measure"]))[:k]])
        return np.concatenate(out) if out else np.zeros(0, FOUND)

    return answer


def nearest(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest rows found for each query row, by Euclidean distance.  is_query: over column `id`.

    Returns query_id, rank, id, distance.
    """
    rows = finite_vectors(table, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if sizes:
        rows = rows.where(F.size("vector") == sizes[0].n)
    return search(rows, is_query, _build, _answer(k), k).select("query_id", "rank", "id", F.col("measure").alias("distance"))
