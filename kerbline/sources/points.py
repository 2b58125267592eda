"""Point clouds in PCD files (the published text header, then ASCII or plain binary rows): decoded to one row a point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points a batch: a cloud is handed on in pieces of this size.
PIECE = 65_536
_END = b"\nDATA "


def header(content: bytes) -> tuple[dict[str, list[str]], int]:
    """Entries of a PCD header and where the rows start; a broken header is an error."""
    at = content.find(_END)
    stop = content.find(b"\n", at + 1) if at >= 0 else -1
    if stop < 0:
        raise ValueError("no PCD header")
    lines = (line.split() for line in content[:stop].decode("ascii").splitlines() if line and not line.startswith("#"))
    return {line[0].upper(): line[1:] for line in lines if line}, stop + 1


def decode(content: bytes, fields: list[str]) -> dict[str, np.ndarray]:
    """The asked fields as doubles, a field that the file lacks as NaN; fields of several values give their first."""
    head, start = header(content)
    names, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    form = head["DATA"][0].lower()
    if form == "binary":
        kinds = [{"F": "f", "I": "i", "U": "u"}[t.upper()] + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
        row = np.dtype([(f"c{i}", f"<{k}", (c,)) for i, (k, c) in enumerate(zip(kinds, counts, strict=True))])
        if len(content) - start < n * row.itemsize:
            raise ValueError("PCD rows end early")
        rows = np.frombuffer(content, row, n, start)
        held = {name: rows[f"c{i}"][:, 0].astype(float) for i, name in enumerate(names)}
    elif form == "ascii":
        values = np.array(content[start:].split(), float)
        if len(values) < n * sum(counts):
            raise ValueError("PCD rows end early")
        table = values[: n * sum(counts)].reshape(n, sum(counts))
        held = {name: table[:, at] for name, at in zip(names, np.cumsum([0, *counts[:-1]]), strict=True)}
    else:
        raise ValueError(f"PCD rows as {form} are not read")
    return {f: held.get(f, np.full(n, np.nan)) for f in fields}


def read_points(files: DataFrame, key: str, content: str, fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> DataFrame:
    """(key, place, fields, error): a row a point in the file's order.

    A null content is a sensor that was not asked for: no row.  A file that can't be decoded is one row with its error and
    no point, as one bad file should not end a job over many.  Clouds leave in pieces, so only the file itself is held.
    """
    kind = files.schema[key].dataType.simpleString()
    columns = ", ".join(f"`{f}` double" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for i, body in enumerate(batch.column(1)):
                if not body.is_valid:
                    continue
                try:
                    points, error = decode(body.as_py(), list(fields)), None
                except (ValueError, KeyError, IndexError, UnicodeDecodeError, TypeError) as e:
                    points, error = None, f"{type(e).__name__}: {e}"
                n = len(next(iter(points.values()))) if points else 1
                for low in range(0, n, PIECE):
                    size = min(PIECE, n - low)
                    own = keys.take(pa.array([i] * size, pa.int64()))
                    if points is None:
                        values = [pa.nulls(1, pa.float64())] * len(fields)
                    else:
                        values = [pa.array(points[f][low : low + size], from_pandas=True) for f in fields]
                    places = pa.nulls(1, pa.int64()) if points is None else pa.array(np.arange(low, low + size))
                    yield pa.RecordBatch.from_arrays([own, places, *values, pa.array([error] * size, pa.string())], names=["key", "place", *fields, "error"])

    return files.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(run, f"key {kind}, place long, {columns}, error string").withColumnRenamed("key", key)


def encoded(points: Column, fields: tuple[str, ...] = ("x", "y", "z", "intensity")) -> Column:
    """An array of arrays of numbers (a point each, as many as the fields) as a binary PCD file of 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(clouds: pd.Series) -> pd.Series:
        def one(cloud) -> bytes | None:
            if cloud is None:
                return None
            rows = np.array([np.asarray(p, "<f4") for p in cloud], "<f4").reshape(-1, len(fields))
            ones, n = " ".join(["1"] * len(fields)), len(rows)
            head = f"VERSION .7\nFIELDS {' '.join(fields)}\nSIZE {' '.join(['4'] * len(fields))}\nTYPE {' '.join(['F'] * len(fields))}\nCOUNT {ones}\nWIDTH {n}\nHEIGHT 1\nPOINTS {n}\nDATA binary\n"
            return head.encode("ascii") + rows.tobytes()

        return clouds.map(one)

    return pack(points)
