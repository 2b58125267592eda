"""Operator 7: exact substring dedup by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first `width` bytes.  They are first dealt by the anchor of that
prefix (see `repeats`), then each bucket orders its own by most-significant-digit passes of eight bytes;
a suffix that is alone in its group after a pass is finished and leaves.  Groups that are still equal after
the last pass are exactly the repeated windows.

Edge cases: null and empty texts give zero bytes and nothing removed; matches never cross rows; a null id
comes before every id and is returned as null; rows that share an id never remove each other's bytes; an
empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import added, ids_back, ids_of, text_array
from .repeats import Supers, Units, repeated, run_spans

#: Bytes of the grams that choose anchors: long enough that few grams repeat by chance.
GRAM_BYTES = 20


def radix_groups(body: np.ndarray, off: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Group number of every window, most significant digit first; -1 where a window occurs once."""
    at = np.repeat(off[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    load = np.ndarray((len(body) + 1,), ">u8", padded, 0, (1,))
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for depth in range(0, width, 8):
        digit = load[at[live] + depth].astype(np.uint64)
        if width - depth < 8:
            digit &= np.uint64(2**64 - 2 ** (8 * (8 - width + depth)))
        order = np.lexsort((digit, group[live]))
        g, d = group[live][order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(number) else new
        live = live[order]
        group[live[~many]] = -1
        group[live] = np.where(many, number, -1)
        live = live[many]
        if not len(live):
            break
    return group


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, whole_chars: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Remove every byte that a `width`-byte string covers which also starts in a document with a smaller id.

    columns: of the input, to pass on instead of the id alone; all but the text come back, and an added column whose
    name one of them has takes underscores until it is free.
    whole_chars: keep a character unless all its bytes go, so that what is left is text again.

    Returns doc_id, n_bytes, removed (array of start and end, maximal runs) and kept (the remaining bytes).
    """
    units = Units(width, min(GRAM_BYTES, max(1, width // 2)), False, False)

    def finish(table: pa.Table, s: Supers, gone: np.ndarray) -> pa.Table:
        ids, off = ids_of(table["doc_id"]), s.cuts
        if whole_chars and len(gone):
            first = np.flatnonzero((s.data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(gone))))
        lo, hi = run_spans(gone, off)
        owner = np.searchsorted(off, lo, "right") - 1
        spans = np.searchsorted(lo, off)
        kept_off = np.concatenate([[0], np.cumsum(~gone)])[off]
        pairs = pa.StructArray.from_arrays([pa.array(lo - off[owner]), pa.array(hi - off[owner])], ["start", "end"])
        return pa.table(
            {
                "doc_id": ids_back(ids),
                "n_bytes": pa.array(np.diff(off), pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs),
                "kept": text_array(s.data[~gone], kept_off, pa.binary()),
            }
        )

    schema = T._parse_datatype_string("doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    if not columns:
        return repeated(docs, id_col, text_col, units, radix_groups, finish, schema)
    rest = [c for c in columns if c != text_col]
    found = repeated(docs, id_col, text_col, units, radix_groups, finish, schema, rest)
    outputs = ("n_bytes", "removed", "kept")
    return found.select("rest.*", *[F.col(c).alias(name) for c, name in zip(outputs, added(rest, *outputs), strict=True)])
