"""Array kernels and plan helpers that several training-data operators share.

Text reaches Python as Arrow buffers; words, hashes and windows are computed over
whole buffers with numpy, so no step runs once per row or per character in Python.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.session import cut  # noqa: F401  modules of the subpackage take it from here

#: The bytes that separate words, space and tab to carriage return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text bytes that one block (one call of a grouped function) holds on average.
BLOCK_BYTES = 1_000_000
#: Text bytes that one step of a streaming function holds.
PIECE_BYTES = 1_000_000
#: Keys that one bucket of a key exchange holds on average.
BUCKET_KEYS = 500_000
#: Blocks whose messages are merged before they go on to buckets.
BAND_BLOCKS = 4096

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FULL = np.uint64(2**64 - 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


# --------------------------------------------------------------------- plan helpers
def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_of(docs: DataFrame, id_col: str, text_col: str, columns: list[str] | None = None) -> tuple[DataFrame, int, int]:
    """(frame of block, doc_id, text and, if columns are given, a struct `rest` of them; bytes of text; blocks).

    A document's block is a hash of its id and text, so a block has the same rows whenever it is computed anew,
    a hot source and rows that share an id or have none spread over all blocks, and several grouped functions
    reuse one exchange of the texts.
    """
    spark = docs.sparkSession
    rest = [F.struct(*columns).alias("rest")] if columns else []
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *rest)
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * shuffle_partitions(spark), math.ceil(total / BLOCK_BYTES))
    return own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).select("block", *own.columns), total, n


#: Rows that reach Python at a time.
ARROW_ROWS = 1000
_ARROW_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python ARROW_ROWS at a time in this session, unless it was told otherwise: Spark's own number makes batches of many megabytes."""
    if spark.conf.get(_ARROW_KEY) == "10000":
        spark.conf.set(_ARROW_KEY, str(ARROW_ROWS))


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more: the driver's cleaner only acts on what was collected."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def buckets_for(spark: SparkSession, keys: float) -> int:
    return max(shuffle_partitions(spark), math.ceil(keys / BUCKET_KEYS))


@dataclass(frozen=True)
class Route:
    """How messages of blocks reach buckets: straight (one band), or merged by band on the way.

    A band's merging task serves `span` buckets with numbers in a row, their `home`.
    """

    buckets: int
    bands: int
    span: int

    def home(self, bucket: np.ndarray) -> np.ndarray:
        return bucket // self.span


def route_for(spark: SparkSession, keys: float, blocks: int) -> Route:
    """A route for `keys` keys in all.  A band's merging task holds as many keys as a bucket does, so more blocks mean more bands, not larger tasks."""
    buckets, bands = buckets_for(spark, keys), math.ceil(blocks / BAND_BLOCKS)
    return Route(buckets, bands, 1 if bands == 1 else math.ceil(buckets / buckets_for(spark, keys / bands)))


def relay(messages: DataFrame, route: Route, merge: Callable, answer: Callable, spread: Callable, schema: str, totals: bool = False) -> DataFrame:
    """Answers of buckets to the messages (bucket, block, ...) that blocks sent to homes.

    With one band the homes are the buckets and `answer` sees all messages.  With more, a key that every block has
    reaches its bucket once a band: merge(key, messages) writes a band's messages as one message a bucket, whose
    `block` is the band's number there; answer(key, merged messages) is the same as ever; spread(key, messages,
    answers) hands the answers on to the blocks.  totals: rows of `answer` without a block are kept beside.
    """
    if route.bands == 1:
        return messages.groupBy("bucket").applyInArrow(answer, schema)
    sent = messages.withColumn("band", F.col("block") % route.bands).groupBy("bucket", "band")
    found = sent.applyInArrow(merge, messages.schema).groupBy("bucket").applyInArrow(answer, schema)
    if totals:
        found = cut(found)
    back = found.where("block is not null").withColumn("home", F.expr(f"block div {route.bands}")).withColumn("band", F.col("block") % route.bands)
    out = sent.cogroup(back.groupBy("home", "band")).applyInArrow(spread, schema)
    return out.unionByName(found.where("block is null")) if totals else out


def heads_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


# --------------------------------------------------------------------- buffers
def buffers(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], col.type)
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def ids_of(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Document ids as int64; null comes before every id."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.int64())
    return arr.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


#: Stands for a null id inside the kernels.
NULL_ID = -(2**63)


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, cuts): words of all texts, and the index of each text's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_IS_SEP[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[off[off < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[off[off > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            have = len(_powers[i])
            step = np.uint64(pow(int(p), have, 2**64))
            _powers[i] = np.concatenate([_powers[i], _powers[i][: max(1, min(have, n - have))] * step])
    return _powers[0], _powers[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for every span of a few hashed units: a polynomial over one prefix sum.

    Polynomials modulo a power of two have collisions by construction from about a thousand units on; spans of any
    length are told apart by `span_keys`.
    """
    n = len(values)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


#: Bytes from which a span is digested on its own instead of eight bytes at a time abreast with others.
LONG_SPAN = 4096


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two arrays, that tell the byte spans data[start:end] apart, whatever their length."""
    size = ends - starts
    one, two = mix(size.astype(np.uint64) + _P), size.astype(np.uint64) * _M2 + _M1
    if not len(size):
        return one, two
    load = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    live, done = np.flatnonzero((size > 0) & (size < LONG_SPAN)), 0
    while len(live):
        left = np.minimum(size[live] - done, 8)
        v = load[starts[live] + done] & (_FULL >> (np.uint64(64) - left.astype(np.uint64) * np.uint64(8)))
        one[live] = mix((one[live] ^ v) + _M1)
        two[live] = mix((two[live] + v * _P) ^ _M2)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size >= LONG_SPAN).tolist():
        digest = np.frombuffer(hashlib.blake2b(np.ascontiguousarray(data[starts[i] : ends[i]]), digest_size=16).digest(), "<u8")
        one[i], two[i] = digest
    return one, two


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:end] of every span put end to end, and the offsets of the parts."""
    lens = ends - starts
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return data[np.arange(off[-1]) + np.repeat(starts - off[:-1], lens)], off


def pieces(table: pa.Table | pa.RecordBatch, column: str, most: int = PIECE_BYTES):
    """Cut a batch into runs of rows of about `most` text bytes; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(table[column]), 0)).astype(np.int64)
    at, total = 0, 0
    for i, x in enumerate(size):
        if i > at and total + x > most:
            yield table.slice(at, i - at)
            at, total = i, 0
        total += x
    if at < len(size):
        yield table.slice(at)


def text_array(data: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A string or binary column from bytes and offsets."""
    big = pa.large_string() if kind in (pa.string(), pa.large_string()) else pa.large_binary()
    arr = pa.Array.from_buffers(big, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return arr.cast(kind) if off[-1] < 2**31 else arr


_held: dict[str, object] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def claim(name: str, clear=None) -> None:
    """A worker runs one operator after another: what the others keep is given back when `name` begins."""
    if list(_held) != [name]:
        for drop in _held.values():
            if drop is not None:
                drop()
        _held.clear()
        _held[name] = clear
        gc.collect()
        trim()


def trim() -> None:
    """Give memory that is free back to the system, so that an idle worker holds little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Memo:
    """What a worker has computed for distinct words: by their bytes, dropped as a whole beyond `most` words or MEMO_BYTES, so memory is bounded."""

    def __init__(self, most: int):
        self.most, self.held, self.at = most, 0, {}

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, compute) -> list:
        """The value of each word; compute(list of words as bytes) -> list of values, for those not yet known."""
        if len(self.at) > self.most or self.held > MEMO_BYTES:
            self.at, self.held = {}, 0
        raw, at = data.tobytes(), self.at
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        missing = [w for w in words if w not in at]
        if missing:
            at.update(zip(missing, compute(missing), strict=True))
            self.held += sum(map(len, missing))
        return [at[w] for w in words]


#: Bytes of words that a memo holds.
MEMO_BYTES = 20_000_000


def distinct(keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of one occurrence of each distinct 128-bit key, inverse)."""
    one, two = keys
    order = np.argsort(one)
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    new = np.concatenate([[True], ~same]) if len(a) else np.zeros(0, bool)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def added(columns: list[str], *names: str) -> list[str]:
    """The names of columns that an operator adds: one that the input has too, in any case, takes underscores until it is free."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def batches(stream, column: str):
    """Pieces of a stream of record batches."""
    for batch in stream:
        if batch.num_rows:
            yield from pieces(batch, column)
    trim()
