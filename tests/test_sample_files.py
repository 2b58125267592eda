"""Samples as one document a file."""

from __future__ import annotations

from kerbline.sources import samples


def test_the_last_of_a_token_stands_and_others_are_left_alone(spark, tmp_path):
    path = str(tmp_path / "samples")
    make = lambda rows: spark.createDataFrame(rows, "token string, cot_output string, n int")
    samples.write_sample_files(make([("a", "first", 1), ("a", "second", 2), ("b/c d", "odd\nname", 1), ("e", None, None)]), path, ["n"])
    samples.write_sample_files(make([("e", "later", 1)]), path)
    got = {r.token: (r.cot_text, r.has_cot) for r in samples.read_samples(spark, {path: "/r"}).collect()}
    assert got == {"a": ("second", True), "b/c d": ("odd\nname", True), "e": ("later", True)}
    assert len(list((tmp_path / "samples").glob("sample=*/*.json"))) == 3


def test_rows_that_tie_give_one_file(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [("a", "x")] * 3 + [("b", "x"), ("b", "y")]
    samples.write_sample_files(spark.createDataFrame(rows, "token string, cot_output string"), path)
    assert sorted((r.token, r.cot_text) for r in samples.read_samples(spark, {path: "/r"}).collect()) == [("a", "x"), ("b", "y")]


def test_small_sample_files_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "many")
    samples.write_sample_files(spark.range(40).selectExpr("'t' || id AS token", "'x' AS cot_output"), path)
    files = list((tmp_path / "many").rglob("part-*.json"))
    assert len(files) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1  # numbers of the tasks
