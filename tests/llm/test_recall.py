"""Recall of the nearest-neighbour search on the 64-dimension table, in several chunks."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def test_recall_over_several_chunks(spark, monkeypatch):
    from kerbline.llm import grid
    from kerbline.llm.queries import op6_nearest

    monkeypatch.setattr(grid, "CANDIDATES", 300)
    monkeypatch.setattr(grid, "QUERIES", 8)
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all() and any(v)]
    ids, vectors = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    assert vectors.shape[1] == 64 and len(ids) > 1500
    found = defaultdict(set)
    for r in op6_nearest(spark, sf_dir).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q, v in good:
        if q % 100 == 0:
            away = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            best = [i for _, i in sorted((d, i) for d, i in zip(away.tolist(), ids.tolist(), strict=True) if i != q)[:10]]
            hits, total = hits + len(found[q] & set(best)), total + 10
    print(hits, total)
    assert hits / total >= 0.95
