"""Clashing columns, hot and null ids, repeated rows, empty tables and long texts, in every operator on texts and every stage."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Names that operators and stages use inside or add.
NAMES = "row rest doc key at rank level n first block bucket part kept removed n_bytes n_lines n_removed emptied gone lang_pred score bits_per_byte component_id root node held_out".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(("stone", "river", "and", "the", "over", "night", "walks", f"n{rng.randint(0, 99)}")) for _ in range(n))
    passage = text(70)
    rows = [(1, passage), (2, passage), (3, text(40) + " " + passage), (4, None), (5, ""), (None, passage), (None, text(50)), (None, None), (7, text(9)), (7, text(9)), (8, text(60_000))]
    rows += [(9, passage + "\n" + text(12)), (9, passage + "\n" + text(12)), (10, "½ ²"), (11, "áb " * 30)]
    rows += [rows[8]] * 3 + [(None, "the river walks over the night and the stones")] * 4
    frame = spark.createDataFrame([(d, t, "en", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, n_chars int")
    for name in NAMES:
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    return frame


def test_stages_keep_clashing_columns(spark, docs, tmp_path):
    import corpus_pipeline as pipeline

    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, docs.limit(0), "").collect() == [], name
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert now.columns == docs.columns
            found = now.collect()
            assert found and all(r[c] == f"own {c}" for r in found for c in NAMES)
            assert all(r.n_chars == len(r.text) for r in found)
            assert any(r.doc_id == 8 and len(r.text) > 100_000 for r in found)
        if name == "language_id":
            assert {r.doc_id for r in found if r.doc_id is not None} == {1, 2, 3, 7, 8, 9, 11} and len(found) == docs.count() - 4


def test_operators_rename_what_they_add(docs):
    from kerbline.llm.language_id import fit, identify
    from kerbline.llm.line_dedup import dedup_lines
    from kerbline.llm.radix_substrings import dedup_substrings

    some = ["doc_id", "score", "kept", "n_bytes"]
    assert identify(docs, fit(docs), columns=some).columns == [*some, "lang_pred", "score_", "bits_per_byte"]
    assert dedup_substrings(docs, columns=some).columns == [*some, "n_bytes_", "removed", "kept_"]
    lines = dedup_lines(docs)
    assert lines.columns == [*docs.columns, "n_lines_", "n_removed_", "emptied_"] and lines.count() == docs.count()


def test_hot_ids_spread_over_blocks(spark):
    from kerbline.llm.common import blocks_of

    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    base, _, n = blocks_of(rows, "doc_id", "text")
    counts = [r["count"] for r in base.groupBy("block").count().collect()]
    assert len(counts) == n and max(counts) < 2 * 100_000 / n


def test_null_ids_in_numbers(spark):
    from kerbline.llm.fm_index import dedup_word_windows
    from kerbline.llm.line_dedup import dedup_lines
    from kerbline.llm.near_dedup import near_duplicates
    from kerbline.llm.radix_substrings import dedup_substrings

    parts = [F.concat(F.lit(f"word{k}x"), "id") for k in range(24)]
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))
    assert dedup_word_windows(rows).where("kept = ''").count() == 0
    assert dedup_substrings(rows).where("size(removed) > 0").count() == 0
    assert dedup_lines(rows).where("n_removed > 0").count() == 0
    assert near_duplicates(rows).where("component_id IS NULL").count() == 20_000
