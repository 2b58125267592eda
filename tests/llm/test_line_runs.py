"""Line dedup with the length measured on the whole repeated run."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F


def plain_runs(rows, min_lines, min_chars):
    """(kept text, lines removed) by id: a line goes if a run that holds it and counts occurs at an earlier place."""
    first, lines, counting = {}, {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines[d] = (t or "").split("\n")
        counting[d] = [i for i, x in enumerate(lines[d]) if x.replace("\t", "").replace("\r", "").strip(" ")]
        for i in range(len(counting[d])):
            for j in range(i + 1, len(counting[d]) + 1):
                first.setdefault(tuple(lines[d][k] for k in counting[d][i:j]), (d, i))
    out = {}
    for d, t in rows:
        gone = set()
        for i in range(len(counting[d])):
            for j in range(i + min_lines, len(counting[d]) + 1):
                run = tuple(lines[d][k] for k in counting[d][i:j])
                if sum(map(len, run)) >= min_chars and first[run] != (d, i):
                    gone |= set(counting[d][i:j])
        out[d] = (None if t is None else "\n".join(x for i, x in enumerate(lines[d]) if i not in gone), len(gone))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ijk") for _ in range(n - 1)) + "."
    verse, alone = [line(24) for _ in range(30)], line(60)
    mixed = [line(n) for n in (60, 4, 55, 3, 2, 49, 1, 70, 5)]
    out = [(1, "\n".join(verse)), (2, "\n".join([line(30), *verse, line(30)])), (3, "\n".join([line(9), alone, line(9)])), (4, "\n".join([line(12), alone, line(12)])), (5, alone), (6, alone[:49])]
    out += [(7, "\n".join(mixed)), (8, "\n\n \t\n".join([line(20), *mixed, line(20)])), (9, alone[:49]), (10, None), (11, ""), (12, " \n\t"), (13, "\n".join(["}"] * 120)), (14, "\n".join(["}"] * 30)), (15, "\n".join(["ab", *verse[3:5], "cd"]))]
    few = ["x" * k for k in (1, 2, 7, 13, 20, 26, 50)] + [""]
    out += [(100 + k, "\n".join(rng.choice(few) for _ in range(rng.randint(1, 14)))) for k in range(60)]
    return out


@pytest.mark.parametrize("min_lines,min_chars", [(1, 50), (2, 50), (3, 20), (1, 1), (5, 0)])
def test_runs_against_plain_version(spark, rows, min_lines, min_chars):
    from kerbline.llm.line_dedup import dedup_lines

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_runs(rows, min_lines, min_chars)
    assert {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs, min_lines=min_lines, min_chars=min_chars).collect()} == want
    assert dedup_lines(docs.limit(0)).collect() == []
    twice = dedup_lines(spark.createDataFrame([(None, "y" * 60), (3, "y" * 60), (3, "y" * 60), (3, "z" * 60), (3, "z" * 60)], "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.text[:1], r.emptied) for r in twice.collect()) == [("3", "", True), ("3", "", True), ("3", "z", False), ("3", "z", False), ("None", "y", False)]
    shared = dedup_lines(spark.createDataFrame([(3, "y" * 60), (3, "y" * 60 + "\n" + "z" * 60), (4, "z" * 60)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in shared) in ([(3, 0), (3, 1), (4, 1)], [(3, 0), (3, 0), (4, 1)], [(3, 1), (3, 0), (4, 1)])
    assert not re.search("Python|Pandas|Arrow", dedup_lines(docs)._jdf.queryExecution().executedPlan().toString())


def test_pipeline_stage_drops_short_lines_of_long_copies_and_single_lines(spark, rows):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text"))
    found = {r.doc_id: r.text for r in pipeline.drop_repeated_lines(spark, docs, "").collect()}
    want = plain_runs(rows, 1, 50)
    assert {d: t for d, t in found.items() if t} == {d: t for d, (t, _) in want.items() if t and t.strip()} | {12: " \n\t"}
    assert len(found[2].split("\n")) == 2 and len(found[4].split("\n")) == 2 and 5 not in found
