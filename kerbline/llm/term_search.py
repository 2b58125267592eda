"""Operator 4: exact top-k by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights on terms (component numbers).  A candidate chunk is inverted:
each term has a posting list of rows and weights.  A query chunk walks the terms once; each query that has
the term scatters its weight times the posting weights into its dense score array.  A partition selection
then takes the k best of the array, and chunks are merged.

Edge cases: null ids and vectors and such as hold null or non-finite components take no part; an empty vector
scores 0; a query never finds its own row, but finds other rows with its id; ties go to the smaller id;
fewer candidates than k give all of them; an empty table gives an empty result; other columns are not read.
Scores are exact whole numbers: where sums could pass 2^62 they are added up as Python integers, and a score that is
no 64-bit number, or a component that its scale makes infinite, is an error that says so.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import Column, DataFrame

from .grid import FOUND, finite_vectors, search

#: Entries of the dense score arrays that are held at once.
DENSE = 262_144
#: Sums below this are added up in 64 bits.
EXACT = 2**62
#: A posting list that holds this share of a chunk's rows or more is laid out as a whole row before it is scattered.
LONG = 0.125


def _build(scale: float):
    def build(ids: np.ndarray, vectors: list[list[float]], asks: bool) -> bytes:
        """Rows as (terms, weights) for queries; term -> (rows, weights) for candidates; zero weights are left out."""
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
        row = np.repeat(np.arange(len(ids)), sizes)
        term = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        with np.errstate(over="ignore"):
            weight = np.floor(scale * np.fromiter((x for v in vectors for x in v), np.float64, len(row)))
        if not np.isfinite(weight).all():
            raise ValueError("a component times the scale is no finite number")
        weight = weight.astype(np.int64) if np.abs(weight).max(initial=0) < EXACT else np.array([int(x) for x in weight], object)
        row, term, weight = row[weight != 0], term[weight != 0], weight[weight != 0]
        by = np.lexsort((row, term))
        terms, first = np.unique(term[by], return_index=True)
        marks = [hashlib.blake2b(np.array(v, np.float64).tobytes(), digest_size=16).digest() for v in vectors]
        return pickle.dumps((ids, marks, terms, np.append(first, len(by)), row[by].astype(np.int32), weight[by]))

    return build


def _answer(k: int):
    def answer(ask: bytes, have: bytes) -> np.ndarray:
        q_ids, q_marks, q_terms, q_cut, q_row, q_weight = pickle.loads(ask)
        ids, marks, terms, cut, row, weight = pickle.loads(have)
        n = len(ids)
        at = {t: i for i, t in enumerate(terms.tolist())}
        top = int(np.abs(q_weight).max(initial=0)) * int(np.abs(weight).max(initial=0)) * max(1, len(q_terms))
        kind = np.int32 if top < 2**31 else np.int64 if top < EXACT else object
        weight, q_weight = weight.astype(kind), q_weight.astype(kind)
        # a query's own row: the same id and the same vector (one of them, where rows are repeated)
        own = _own_rows(q_ids, q_marks, ids, marks)
        out = []
        step = max(1, DENSE // max(1, n))
        whole: dict[int, np.ndarray] = {}
        for j in range(len(terms)):
            if cut[j + 1] - cut[j] >= LONG * n:
                whole[j] = np.zeros(n, kind)
                whole[j][row[cut[j] : cut[j + 1]]] = weight[cut[j] : cut[j + 1]]
        for lo in range(0, len(q_ids), step):
            hi = min(len(q_ids), lo + step)
            dense, adds = np.zeros((hi - lo, n), kind), np.empty((hi - lo, n), kind)
            for i, t in enumerate(q_terms.tolist()):
                j = at.get(t)
                if j is None:
                    continue
                a, b = np.searchsorted(q_row[q_cut[i] : q_cut[i + 1]], (lo, hi)) + q_cut[i]
                if a == b:
                    continue
                rows, mine = q_row[a:b] - lo, q_weight[a:b]
                if j not in whole:
                    cols = row[cut[j] : cut[j + 1]]
                    dense[np.ix_(rows, cols)] += np.multiply.outer(mine, weight[cut[j] : cut[j + 1]])
                elif 2 * len(rows) < hi - lo:
                    dense[rows] += np.multiply.outer(mine, whole[j])
                else:
                    every = np.zeros(hi - lo, kind)
                    every[rows] = mine
                    np.multiply(every[:, None], whole[j][None, :], out=adds)
                    dense += adds
            # scores with the place as tie-break: candidates are in the order of their ids
            for r in range(hi - lo):
                keep = np.arange(n) if own[lo + r] < 0 else np.delete(np.arange(n), own[lo + r])
                score = dense[r, keep] if kind is object else dense[r, keep].astype(np.int64)
                if len(keep) > k:
                    edge = np.partition(score, len(score) - k)[len(score) - k]
                    sure = np.flatnonzero(score > edge)
                    even = np.flatnonzero(score == edge)[: k - len(sure)]
                    pick = np.concatenate([sure, even])
                else:
                    pick = np.arange(len(keep))
                found = np.empty(len(pick), FOUND)
                found["place"], found["query"], found["id"] = lo + r, q_ids[lo + r], ids[keep[pick]]
                if kind is object and any(abs(x) >= 2**63 for x in score[pick]):
                    raise ArithmeticError(f"a score of query {q_ids[lo + r]} is no 64-bit number")
                found["score"], found["measure"] = score[pick].astype(np.int64), -score[pick].astype(np.float64)
                out.append(found)
        return np.concatenate(out) if out else np.zeros(0, FOUND)

    return answer


def _own_rows(q_ids: np.ndarray, q_marks: list[bytes], ids: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """The place of each query's own row, or -1.  Equal rows are all in one chunk, so one chunk only leaves one out."""
    own = np.full(len(q_ids), -1)
    lo, hi = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    for i in np.flatnonzero(hi > lo).tolist():
        own[i] = next((j for j in range(lo[i], hi[i]) if marks[j] == q_marks[i]), -1)
    return own


def top_k(table: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, k: int = 20) -> DataFrame:
    """The k rows with the highest integer inner product for each query row; weights are floor(scale * component).

    is_query: over column `id`.  Returns query_id, rank, id, score.
    """
    return search(finite_vectors(table, id_col, vector_col), is_query, _build(scale), _answer(k), k).select("query_id", "rank", "id", "score")
