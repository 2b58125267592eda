"""Files of length-framed records: a data source with byte-range partitions and checksums, and stores of records by key.

A record is its length (8 bytes, little-endian), the masked CRC-32C of these bytes, the payload and its masked CRC-32C.
Files are read in ranges of `splitbytes`.  A record belongs to the range in which it begins; a range that begins inside
a record finds the next one by looking for eight bytes before their own checksum, and follows the records from there to
its end: a find whose chain breaks was part of a payload, and the search goes on behind it.  Only a payload that holds
well-formed records throughout a whole range could be taken for records; such files are read whole (splitbytes 0).

Edge cases: an empty file has no records; a file that is cut off, and a checksum that does not fit, are errors, also at the
start of a file; files whose names begin with a dot or an underscore are left out; a null payload can't be written.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .checksum import checksums, lengths_that_fit, masked

#: Bytes of a range, of a read, and of payloads that go on as one batch.
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 4 << 20, 8 << 20
SCHEMA = "path string, position long, payload binary"


class RecordError(ValueError):
    """Bytes that are no well-formed record."""


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:").removeprefix("//") if path.startswith("file:") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int


class _Window:
    """Bytes of a file by position; reads go on from one another."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def take(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, fewer at the end of the file."""
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, READ_BYTES))
        return self.held[at - self.at : at - self.at + n]


def _length(window: _Window, at: int) -> int | None:
    """The length of the payload of a record at a position, if one begins there."""
    head = window.take(at, 12)
    if len(head) < 12 or not len(lengths_that_fit(np.frombuffer(head, np.uint8))):
        return None
    return struct.unpack_from("<Q", head)[0]


def _holds(window: _Window, at: int, stop: int) -> bool:
    """Whether records follow one another from `at` to the end of the range or of the file."""
    while at < stop:
        size = _length(window, at)
        if size is None or at + 16 + size > window.size:
            return False
        at += 16 + size
    return True


def _first(window: _Window, start: int, stop: int) -> int:
    """Where the first record that begins in a range begins; its end if none does."""
    if not start:
        return 0
    at = start
    while at < stop:
        seen = window.take(at, READ_BYTES)
        for offset in lengths_that_fit(np.frombuffer(seen, np.uint8)).tolist():
            if at + offset >= stop:
                return stop
            if _holds(window, at + offset, stop):
                return at + offset
            seen = None  # the window moved, its bytes are read again when they are looked at
        at += max(1, min(READ_BYTES, window.size - at) - 11)
    return stop


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        system, root = _place(self.path)
        found = system.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                step = self.split or max(1, f.size)
                out += [Range(f.path, at, min(f.size, at + step), f.size) for at in range(0, f.size, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files: Spark asks for the rows of no partition
            return
        system, _ = _place(self.path)
        with system.open_input_file(partition.path) as file:
            window = _Window(file, partition.size)
            at = _first(window, partition.start, partition.stop)
            places, payloads, sums, held = [], [], [], 0
            while at < partition.stop:
                size = _length(window, at)
                if size is None or at + 16 + size > partition.size:
                    raise RecordError(f"{partition.path}: no record at byte {at}")
                body = window.take(at + 12, size + 4)
                places.append(at)
                payloads.append(body[:size])
                sums.append(struct.unpack_from("<I", body, size)[0])
                held += size
                at += 16 + size
                if held >= BATCH_BYTES:
                    yield self._batch(partition.path, places, payloads, sums)
                    places, payloads, sums, held = [], [], [], 0
            if places:
                yield self._batch(partition.path, places, payloads, sums)

    def _batch(self, path: str, places: list[int], payloads: list[bytes], sums: list[int]) -> pa.RecordBatch:
        if self.verify:
            wrong = np.flatnonzero(masked(checksums(payloads)) != np.array(sums, np.uint32))
            if len(wrong):
                raise RecordError(f"{path}: the payload of the record at byte {places[wrong[0]]} does not fit its checksum")
        return pa.RecordBatch.from_pydict({"path": pa.array([path] * len(places)), "position": pa.array(places, pa.int64()), "payload": pa.array(payloads, pa.binary())})


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str
    records: int


class RecordWriter(DataSourceArrowWriter):
    """A file a partition, under a hidden name until the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        system, root = _place(self.path)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        name, n = f"part-{uuid.uuid4().hex}.records", 0
        try:
            with system.open_output_stream(f"{root}/_{name}") as out:
                for batch in iterator:
                    n += self._put(out, batch.column(batch.schema.get_field_index("payload")).to_pylist())
        except Exception:
            system.delete_file(f"{root}/_{name}")
            raise
        return Written(f"{root}/_{name}", f"{root}/{name}", n)

    @staticmethod
    def _put(out: pa.NativeFile, payloads: list[bytes | None]) -> int:
        if None in payloads:
            raise RecordError("a null payload can't be written")
        heads = [struct.pack("<Q", len(p)) for p in payloads]
        for head, a, payload, b in zip(heads, masked(checksums(heads)).tolist(), payloads, masked(checksums(payloads)).tolist(), strict=True):
            out.write(head + struct.pack("<I", a) + payload + struct.pack("<I", b))
        return len(payloads)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root, recursive=True)):
                if f.type == fs.FileType.File and f.base_name.endswith(".records") and not f.base_name.startswith("_"):
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.records:
                system.move(m.temporary, m.final)
            elif m is not None:
                system.delete_file(m.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _place(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class RecordSource(DataSource):
    """Format `records`: path, position (of the record's first byte) and payload; options splitbytes and verify."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if "payload" not in schema.fieldNames():
            raise RecordError("records are written from a column payload")
        return RecordWriter(dict(self.options), overwrite)


def read_records(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, verify: bool = True) -> DataFrame:
    """(path, position, payload) of every record of a file or of all files below a folder."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("records").option("splitbytes", split_bytes).option("verify", str(verify)).load(path)


def write_records(rows: DataFrame, path: str, payload: str = "payload", mode: str = "append") -> None:
    """The payloads as record files, one for each partition that has rows."""
    rows.sparkSession.dataSource.register(RecordSource)
    rows.select(F.col(payload).cast("binary").alias("payload")).write.format("records").mode(mode).save(path)


# --------------------------------------------------------------------- camera frames
#: Camera numbers of recorded frames, fixed values.
CAMERAS = {1: "front", 2: "front_left", 3: "front_right", 4: "left", 5: "right", 6: "back_left", 7: "back", 8: "back_right"}


def _fields(message: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a tagged binary message; length-delimited values as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[at]
            value |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = message[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = message[at : at + size], at + size
        else:
            raise RecordError(f"field of kind {kind}")
        yield tag >> 3, value


def camera_images(records: DataFrame) -> DataFrame:
    """sequence, camera, file_name and image of every picture of every frame message (frame = 1; its context = 1 with name = 1, images = 4 with camera = 1 and bytes = 2)."""

    def run(stream):
        for batch in stream:
            out: list[tuple] = []
            for payload in batch.column(0).to_pylist():
                name, images = "", []
                for number, frame in _fields(memoryview(payload or b"")):
                    for inner, value in _fields(frame) if number == 1 else ():
                        if inner == 1:
                            name = next((bytes(v).decode() for k, v in _fields(value) if k == 1), name)
                        elif inner == 4:
                            images.append(dict(_fields(value)))
                out += [(name.split("-")[0], CAMERAS.get(i.get(1, 0)), f"{name}.jpg", bytes(i.get(2, b""))) for i in images]
            kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["sequence", "camera", "file_name", "image"])

    return records.select("payload").mapInArrow(run, "sequence string, camera string, file_name string, image binary")


def delimited(number: int, value: Column) -> Column:
    """A length-delimited field, number below 16, of up to 16,383 bytes, as it stands in a message."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    byte = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    size = F.when(n < 128, byte(n)).otherwise(F.concat(byte(n % 128 + 128), byte(F.floor(n / 128))))
    return F.concat(byte(F.lit(number * 8 + 2)), size, raw)


def build_store(records: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """Records by key, made once: an existing store is left as it is.  Files hold one hash range of keys each, sorted, so that a read of one key prunes."""
    from pyspark.errors import AnalysisException

    try:
        records.sparkSession.read.parquet(path)
    except AnalysisException:  # there is none yet
        by = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int").alias("bucket")
        records.select("*", by).repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def stored(spark: SparkSession, path: str, key: str, value: str, buckets: int = 64) -> DataFrame:
    """The record of one key: only its bucket is read."""
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(value)), F.lit(buckets)).cast("int")).first()[0]
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")
