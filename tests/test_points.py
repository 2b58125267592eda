"""Point clouds: both forms of rows, broken files, clouds of several pieces."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from kerbline.sources import points

MIXED = b"# made by hand\nVERSION .7\nFIELDS x y ring stamp normal\nSIZE 4 8 1 2 4\nTYPE F F U I F\nCOUNT 1 1 1 1 3\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA binary\n" + b"".join(
    struct.pack("<fdBh3f", *r) for r in ((1.5, -2.25, 200, -3, 1, 2, 3), (0.5, 1e300, 0, 7, 4, 5, 6))
)
ASCII = b"VERSION .7\nFIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nPOINTS 2\nDATA ascii\n1 2 3\n4.5 nan 6\n"


def test_fields_of_any_kind_and_those_that_are_lacking(spark):
    files = spark.createDataFrame([("m", bytearray(MIXED)), ("a", bytearray(ASCII)), ("none", None)], "token string, body binary")
    got = points.read_points(files, "token", "body", ("y", "ring", "stamp", "normal", "z")).orderBy("token", "place").collect()
    assert [tuple(r)[:7] for r in got] == [("a", 0, 2.0, None, None, None, 3.0), ("a", 1, None, None, None, None, 6.0), ("m", 0, -2.25, 200.0, -3.0, 1.0, None), ("m", 1, 1e300, 0.0, 7.0, 4.0, None)]
    assert {r.error for r in got} == {None}


def test_a_bad_file_is_a_row_with_its_error(spark):
    bad = [b"", b"no header", MIXED[:-1], ASCII.replace(b"DATA ascii", b"DATA binary_compressed"), ASCII.replace(b"TYPE F F F\n", b"").replace(b"DATA ascii", b"DATA binary"), ASCII.replace(b"POINTS 2", b"POINTS")]
    files = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bad)] + [(99, bytearray(ASCII))], "id long, body binary")
    got = points.read_points(files, "id", "body").collect()
    assert sorted((r.id, r.place) for r in got if r.error is None) == [(99, 0), (99, 1)]
    assert sorted(r.id for r in got if r.error is not None and r.place is None and r.x is None) == list(range(len(bad)))


def test_clouds_of_several_pieces_and_of_none(spark):
    n = points.PIECE + 3
    clouds = spark.createDataFrame([(1, n), (2, 0), (3, None)], "id long, n int")
    cloud = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(i.cast("double"), i / 2.0))).when(F.col("n") == 0, F.array().cast("array<array<double>>"))
    files = clouds.select("id", points.encoded(cloud, ("x", "y")).alias("body"))
    got = points.read_points(files, "id", "body", ("x", "y"))
    assert got.groupBy("id").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max("y").alias("top")).collect() == [(1, n, n - 1, n / 2)]
