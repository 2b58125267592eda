"""Search of a query set against all rows, in blocks.

Both sides are packed into chunks of bounded size; every pair of a query chunk and a candidate chunk is one
task, whose answer is the best rows per query.  Answers are merged in groups of MERGE chunks until one is
left per query chunk, so no task ever sees more than a bounded part of either side.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rows of a candidate chunk and of a query chunk, on average.
CANDIDATES, QUERIES = 4096, 1024
#: Answers of so many candidate chunks are merged at a time.
MERGE = 64

#: One found row: the query's place in its chunk, its id, the found row's id and the measure (ascending is better).
FOUND = np.dtype([("place", "<i4"), ("query", "<i8"), ("id", "<i8"), ("measure", "<f8"), ("score", "<i8")])


def finite_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector of doubles): without null ids, null vectors and such as hold null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(good, F.lit(False)).alias("good")).where("good and id is not null").drop("good")


def best(found: np.ndarray, k: int) -> np.ndarray:
    """The first k of each query: smallest measure, then highest score (whole numbers, which the measure may round), then smallest id."""
    found = found[np.lexsort((found["id"], -found["score"], found["measure"], found["place"]))]
    new = np.concatenate([[True], found["place"][1:] != found["place"][:-1]]) if len(found) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    rank = np.arange(len(found)) - np.repeat(start, np.diff(np.append(start, len(found))))
    return found[rank < k]


def _merge(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = best(np.concatenate([np.frombuffer(x, FOUND) for x in table["found"].to_pylist()]), k)
        return pa.table({"q": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([key[1].as_py()], pa.int64()), "found": pa.array([found.tobytes()], pa.binary())})

    return run


def _unpack(stream):
    for batch in stream:
        for x in batch["found"].to_pylist():
            f = np.frombuffer(x, FOUND)
            new = np.concatenate([[True], f["place"][1:] != f["place"][:-1]]) if len(f) else np.zeros(0, bool)
            start = np.flatnonzero(new)
            rank = np.arange(len(f)) - np.repeat(start, np.diff(np.append(start, len(f)))) + 1
            yield pa.RecordBatch.from_pydict(
                {
                    "query_id": pa.array(f["query"].copy(), pa.int64()),
                    "rank": pa.array(rank, pa.int32()),
                    "id": pa.array(f["id"].copy(), pa.int64()),
                    "measure": pa.array(f["measure"].copy(), pa.float64()),
                    "score": pa.array(f["score"].copy(), pa.int64()),
                }
            )


def search(rows: DataFrame, is_query: Column, build: Callable, answer: Callable, k: int) -> DataFrame:
    """rows: (id, vector).  build(ids, vectors) -> bytes of a chunk; answer(query bytes, candidate bytes) -> FOUND array.

    Returns query_id, rank (from 1), id, measure, score.
    """
    counts = rows.agg(F.count("*"), F.count_if(is_query)).first()
    n_c, n_q = max(1, math.ceil(counts[0] / CANDIDATES)), max(1, math.ceil(counts[1] / QUERIES))

    def chunked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        vectors = table["vector"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i]))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([build(ids[order], [vectors[i] for i in order], key[1].as_py())], pa.binary())})

    # queries in chunks of their own, by the same hash: equal rows are together on either side, rows that only share an id spread
    place = F.xxhash64("id", "vector")
    sides = rows.select(F.pmod(place, F.lit(n_c)).alias("chunk"), F.lit(False).alias("asks"), "id", "vector").unionAll(
        rows.where(is_query).select(F.pmod(place, F.lit(n_q)).alias("chunk"), F.lit(True).alias("asks"), "id", "vector")
    )

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return chunked(key, table).append_column("asks", pa.array([key[1].as_py()]))

    packs = cut(sides.groupBy("chunk", "asks").applyInArrow(packed, "chunk long, body binary, asks boolean"))
    candidates = packs.where("not asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("q"), F.col("chunk").alias("c"), F.col("body").alias("have"))
    queries = packs.where("asks").select(F.col("chunk").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("c"), F.col("body").alias("ask"))

    def task(key: tuple[pa.Scalar, ...], ask: pa.Table, have: pa.Table) -> pa.Table:
        if not ask.num_rows or not have.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "found": pa.array([], pa.binary())})
        found = best(answer(ask["ask"][0].as_py(), have["have"][0].as_py()), k)
        return pa.table({"q": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([key[1].as_py() // MERGE], pa.int64()), "found": pa.array([found.tobytes()], pa.binary())})

    schema = "q long, c long, found binary"
    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(task, schema)
    left = n_c
    while True:
        found = found.groupBy("q", "c").applyInArrow(_merge(k), schema)
        left = math.ceil(left / MERGE)
        if left <= 1:
            break
        found = found.withColumn("c", F.floor(F.col("c") / MERGE))
    return found.mapInArrow(_unpack, "query_id long, rank int, id long, measure double, score long")
