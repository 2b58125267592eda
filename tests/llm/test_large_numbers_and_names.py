"""Scores beyond 53 bits, languages of odd samples, many ranges of an order, stages on odd column names and shared ids."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F


def plain_top_k(rows, k):
    out = []
    for q, v in rows:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in rows if c != q)
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scores[:k], 1)]
    return out


def test_scores_beyond_doubles(spark):
    from kerbline.llm.term_search import top_k

    rows = [(0, [2.0**23, 1.0 / 64]), (1, [2.0**23, 0.0]), (2, [2.0**23, 1.0 / 64]), (3, [2.0**23, 2.0 / 64]), (4, [-(2.0**23), 0.0])]
    exact = [(i, [int(64 * x) for x in v]) for i, v in rows]
    assert len({float(r[3]) for r in plain_top_k(exact, 3)[:3]}) < 3  # doubles can't tell them apart
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 3):
        assert sorted(tuple(r) for r in top_k(frame, F.col("id") >= 0, k=k).collect()) == sorted(plain_top_k(exact, k))


def test_sums_beyond_64_bits(spark):
    from kerbline.llm.term_search import top_k

    # partial sums pass 2^63, the scores don't
    rows = [(1, [2.0**40, 2.0**40, 1.0]), (2, [2.0**17, -(2.0**17), 3.0]), (3, [2.0**17, -(2.0**17), 3.0 + 1 / 64]), (4, [1.0, 0.0, 0.0])]
    exact = [(i, [int(64 * x) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(frame, F.col("id") <= 4, k=2).collect())
    assert got == sorted(plain_top_k(exact, 2))
    for bad in ([2.0**60, 1.0, 0.0], [1e308, 0.0, 0.0]):
        with pytest.raises(PythonException):
            top_k(frame.union(spark.createDataFrame([(5, bad), (6, bad)], frame.schema)), F.col("id") > 4, k=2).collect()


def test_language_of_letterless_short_texts(spark):
    from kerbline.llm.language_id import fit

    long = "der hund und die katze " * 400
    rows = [(1, "123", "xx"), (2, long, "xx"), (3, long + " und", "xx"), (4, "le chat est ici", "fr"), (5, "42 !", "none")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["fr", "xx"]


def test_many_languages_have_a_bounded_model(spark):
    from kerbline.llm.language_id import fit, identify

    rng = random.Random(300)
    word = lambda k: "".join(chr(97 + (k * 7 + rng.randrange(4) * (1 + k % 5)) % 26) for _ in range(6))
    rows = [(i, " ".join(word(i % 300) for _ in range(60)), f"l{i % 300:03}") for i in range(1200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(frame, model_bytes=20_000_000)
    assert len(model.languages) == 300 and sum(t.nbytes for t in model.tables) < 3 * 20_000_000
    assert fit(frame, model_bytes=200_000_000).bits.sum() > model.bits.sum()
    judged = identify(frame.where("doc_id < 20"), model).collect()
    assert {r.lang_pred for r in judged} <= set(model.languages)


def test_components_whatever_the_ranges(spark, monkeypatch):
    from kerbline.llm import near_dedup

    rng = random.Random(55)
    vocab = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(40)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        if i % 3:
            w[rng.randrange(60)] = "other"
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for part_rows in (500_000, 40):
        monkeypatch.setattr(near_dedup, "PART_ROWS", part_rows)
        found.append(sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame).collect()))
    assert found[0] == found[1] and len({c for _, c in found[0]}) < 300


def test_stages_keep_odd_names_and_shared_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(("stone", "river", "and", "the", "over", "night", "walks", f"n{rng.randint(0, 99)}")) for _ in range(n))
    one, two, three = text(60), text(60), text(60)
    near = two.replace("the", "thé", 1)
    rows = [(1, one), (2, one), (7, one), (7, three), (None, two), (None, near), (8, near), (9, two), (9, text(50))]
    frame = spark.createDataFrame([(d, t, "en", len(t)) for d, t in rows], "doc_id long, text string, lang string, n_chars int")
    for name in ("__gone", "a.b", "gone_id", "GONE_MARK", "mark", "component", "back`tick", "key"):
        frame = frame.withColumn(name, F.lit(f"own {name}"))
    kept = pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    left = sorted((str(r.doc_id), r.text) for r in kept.collect())
    # of the two near texts without an id the one whose digest is smaller stays
    assert len(left) == 4 and ("1", one) in left and ("7", three) in left and ("9", rows[-1][1]) in left and left[-1][0] == "None" and left[-1][1] in (two, near)
    now = frame
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(pipeline.STAGES) - 1:
            assert now.columns == frame.columns and all(r["a.b"] == "own a.b" and r["back`tick"] == "own back`tick" for r in now.collect()), name
