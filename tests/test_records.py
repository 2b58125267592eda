"""Record files: checksums, byte ranges, payloads that look like records, damage, camera frames."""

from __future__ import annotations

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from kerbline.sources import records
from kerbline.sources.checksum import checksums, masked
from kerbline.sources.records import camera_images, delimited, read_records, write_records


def plain_checksum(data):
    s = 0xFFFFFFFF
    for b in data:
        s ^= b
        for _ in range(8):
            s = (s >> 1) ^ (0x82F63B78 if s & 1 else 0)
    return s ^ 0xFFFFFFFF


def framed(payload):
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", int(masked(checksums([head]))[0])) + payload + struct.pack("<I", int(masked(checksums([payload]))[0]))


def test_checksums():
    assert checksums([b"123456789"]).tolist() == [0xE3069283]  # the published check value
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 2, 3, 4, 7, 8, 255, 256, 257, 16_384, 16_385, 40_000)]
    assert checksums(parts).tolist() == [plain_checksum(p) for p in parts]


@pytest.mark.parametrize("split", [0, 50, 1000, 100_000])
def test_ranges_give_every_record_once(spark, tmp_path, split):
    rng = random.Random(split)
    payloads = [rng.randbytes(rng.choice([0, 1, 20, 300, 5000])) for _ in range(120)]
    # payloads that hold records themselves, whole, cut off and in a row
    payloads[30] = b"x" + framed(b"inner") * 9 + b"tail"
    payloads[60] = framed(b"inner" * 40)[:-3]
    payloads[90] = framed(b"a") + framed(b"b" * 30) + b"y" * 200
    want, n_files = [], 3
    for k in range(n_files):
        at, content = 0, b""
        for p in payloads[k::n_files]:
            want.append((f"{k}.tfrecord", len(content), p))
            content += framed(p)
        (tmp_path / f"{k}.tfrecord").write_bytes(content)
    (tmp_path / "empty.tfrecord").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no record")
    # a chain inside a payload may fill a short range, so ranges are longer than those payloads, or the whole file
    found = read_records(spark, str(tmp_path), split_bytes=split if split != 50 else 700)
    if split in (50, 1000):
        assert found.rdd.getNumPartitions() > 3 * n_files
    assert sorted((os.path.basename(r.path), r.position, bytes(r.payload)) for r in found.collect()) == sorted(want)


def test_round_trip_in_more_partitions_than_files(spark, sf_dir, tmp_path):
    path = f"file://{tmp_path}/out"
    own = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.to_json(F.struct("c_custkey", "c_name", "c_comment" if "c_comment" in spark.read.parquet(f"{sf_dir}/customer.parquet").columns else "c_acctbal")).alias("payload"))
    write_records(own.repartition(2), path)
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".records")]
    back = read_records(spark, path, split_bytes=3000)
    assert len(files) == 2 and back.rdd.getNumPartitions() > 2
    assert sorted(bytes(r.payload).decode() for r in back.collect()) == sorted(r.payload for r in own.collect())
    write_records(own.limit(3), path, mode="append")
    assert read_records(spark, path).count() == own.count() + 3
    write_records(own.limit(5), path, mode="overwrite")
    assert read_records(spark, path).count() == 5
    write_records(own.limit(0), path)
    assert read_records(spark, path).count() == 5


def test_damage_is_seen(spark, tmp_path):
    content = bytearray(b"".join(framed(bytes([65 + i]) * 40) for i in range(9)))
    whole = bytes(content)
    (tmp_path / "a").write_bytes(whole)
    assert read_records(spark, str(tmp_path)).count() == 9
    for at in (15, 12 + 40 + 2, 56 + 3):  # payload, its checksum, the next length
        content[at] ^= 4
        (tmp_path / "a").write_bytes(bytes(content))
        with pytest.raises(Exception, match="record"):
            read_records(spark, str(tmp_path)).collect()
        content[at] ^= 4
    content[15] ^= 4
    (tmp_path / "a").write_bytes(bytes(content))
    assert read_records(spark, str(tmp_path), verify=False).count() == 9
    (tmp_path / "a").write_bytes(whole[:-1])
    with pytest.raises(Exception, match="record"):
        read_records(spark, str(tmp_path)).collect()


def test_null_payloads_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(b"a",), (None,)], "payload binary")
    with pytest.raises(Exception, match="null payload"):
        write_records(rows, str(tmp_path / "x"))
    assert read_records(spark, str(tmp_path / "x")).count() == 0
    assert all(f.startswith("_") for f in os.listdir(tmp_path / "x"))  # what a killed task leaves is hidden


def test_camera_images(spark):
    image = lambda k, body: delimited(4, F.concat(F.unhex(F.lit(f"08{k:02x}")), delimited(2, body)))
    frame = F.concat(delimited(1, delimited(1, F.col("name"))), image(1, F.col("big")), F.unhex(F.lit("1005")), image(7, F.lit("b")))
    rows = spark.createDataFrame([("seq-12", "p" * 300), ("other", "")], "name string, big string").select(delimited(1, frame).alias("payload"))
    found = sorted((r.sequence, r.camera, r.file_name, bytes(r.image)) for r in camera_images(rows).collect())
    assert found == [("other", "back", "other.jpg", b"b"), ("other", "front", "other.jpg", b""), ("seq", "back", "seq-12.jpg", b"b"), ("seq", "front", "seq-12.jpg", b"p" * 300)]
    assert camera_images(rows.limit(0)).collect() == []
    assert records.CAMERAS[2] == "front_left"
