"""The near-dedup stage links from a similarity of 0.8 on."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_stage_links_between_80_and_85_percent(spark):
    import corpus_pipeline as pipeline

    def variants(name, n, changed):
        base = [f"{name}{i}" for i in range(n)]
        return " ".join(base), " ".join([*base[: n - changed], *[f"new{name}{i}" for i in range(changed)]])

    # shingles of 5 words: 96 of 100 words each; k changed at the end leave 96 - k in common
    rows = []
    for k, changed in enumerate((9, 10, 11, 16)):  # similarities 87/105, 86/106, 85/107, 80/112
        a, b = variants(f"w{k}x", 100, changed)
        rows += [(2 * k + 1, a), (2 * k + 2, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text"))
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3, 5, 6, 7, 8]
