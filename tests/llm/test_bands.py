"""Blocks merged by band give what blocks that write to buckets straight give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choices(words, k=40)) for _ in range(6)]
    rows = [(None, shared[0]), (5, None), (5, shared[1]), (6, "")]
    for i in range(300):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 50))) for _ in range(2)]
        parts.insert(1, rng.choice(shared)[rng.randint(0, 60) :] if i % 3 else shared[0])
        rows.append((i % 250, " ".join(parts)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture
def narrow(monkeypatch):
    """Small blocks, buckets and bands, so that a band's home serves several buckets."""
    from kerbline.llm import common

    def set_to(band_blocks):
        for name, value in (("BLOCK_BYTES", 4000), ("BUCKET_KEYS", 300), ("BAND_BLOCKS", band_blocks)):
            monkeypatch.setattr(common, name, value)

    return set_to


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_route(spark, narrow):
    from kerbline.llm.common import route_for

    narrow(3)
    route = route_for(spark, 30_000, 24)
    assert (route.buckets, route.bands) == (100, 8) and route.span > 1
    assert route_for(spark, 30_000, 3).span == 1


@pytest.mark.parametrize("name", ["words", "bytes", "counts"])
def test_same_rows(spark, docs, narrow, name):
    from kerbline.llm.fm_index import dedup_word_windows
    from kerbline.llm.hidden_markov import score
    from kerbline.llm.radix_substrings import dedup_substrings

    def found():
        if name == "words":
            return rows_of(dedup_word_windows(docs, width=20))
        if name == "bytes":
            return rows_of(dedup_substrings(docs, width=50))
        columns = ["doc_id", "n_tokens", "n_known", "train_tokens", *(F.round(c, 6).alias(c) for c in ("base_score", "score"))]
        return rows_of(score(docs, F.col("doc_id") % 3 != 1).select(*columns))

    narrow(10**6)
    straight = found()
    narrow(3)
    assert found() == straight
