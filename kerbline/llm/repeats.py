"""Repeated windows across a corpus: the exchange that substring operators share.

A *window* is `width` consecutive units (bytes or words) of one document.  Every window has one
*anchor*, the smallest hash among its `gram`-unit grams (leftmost on ties).  Equal windows have equal
anchors, so neighbouring windows with the same anchor travel together as one *super-window* and windows
that are equal anywhere in the corpus meet in the same bucket.  Four steps, none of which gathers an
unbounded group:

1. each block of documents sends the distinct hashes of its anchors, four bytes each, to buckets;
2. a bucket answers each block with one bit per hash: does it occur elsewhere too;
3. blocks send the distinct super-windows at repeated anchors, one copy per block with its first owner;
   a bucket finds, for every window in them, the first owner in the corpus;
4. blocks apply the answers to their documents.

How step 3 finds equal windows is the operator's method and is passed in as `resolve`.  A passage that a
third of all rows share reaches a bucket once per block, not once per row; where blocks are many, once per band
of blocks (see `common.relay`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Route, blocks_of, buffers, byte_values, claim, gather, heads_of, ids_of, mix, relay, route_for, span_hashes, span_keys, word_spans

_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Units:
    """What a window is made of.  words: units are words, else bytes.  within: an earlier start in the same document counts too."""

    width: int
    gram: int
    words: bool
    within: bool


@dataclass
class Supers:
    """Super-windows of one block: document row, first unit (in the block and in the document), windows, anchor hash, content hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    local: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _grams(values: np.ndarray, units: Units) -> np.ndarray:
    n = len(values) - units.gram + 1
    if units.words:
        out = np.zeros(n, np.uint64)
        for j in range(units.gram):
            out = out * np.uint64(0xD6E8FEB86659FD93) + values[j : j + n]
        return mix(out)
    full, rest = divmod(units.gram, 8)
    padded = np.concatenate([values, np.zeros(8, np.uint8)])
    load = np.ndarray((len(values),), "<u8", padded, 0, (1,))
    out = np.zeros(n, np.uint64)
    for j in range(full):
        out = out * np.uint64(0xD6E8FEB86659FD93) + load[8 * j : 8 * j + n]
    if rest:
        out = out * np.uint64(0xD6E8FEB86659FD93) + (load[8 * full : 8 * full + n] & np.uint64(2 ** (8 * rest) - 1))
    return mix(out)


def supers_of(texts: pa.ChunkedArray | pa.Array, units: Units) -> Supers:
    claim("repeats")
    data, off = buffers(texts)
    if units.words:
        starts, ends, cuts = word_spans(data, off)
        values = span_keys(data, starts, ends)[0]
    else:
        starts = ends = np.zeros(0, np.int64)
        cuts, values = off, data
    n, w = len(values), units.width
    none = np.zeros(0, np.int64)
    if n < w:
        return Supers(data, starts, ends, cuts, none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    gram = _grams(values, units)
    bits = np.uint64(2 ** int(n).bit_length() - 1)
    low = (gram & ~bits) | np.arange(len(gram), dtype=np.uint64)
    span, over = 1, w - units.gram + 1
    while span * 2 <= over:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < over:
        low = np.minimum(low[: -(over - span)], low[over - span :])
    at = (low & bits).astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(cuts[:-1], cuts[1:] - w + 1), 1)
    np.add.at(edge, cuts[1:], -1)
    valid = np.cumsum(edge[: n - w + 1]) == 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    count = np.flatnonzero(last) - first + 1
    doc = np.searchsorted(cuts, first, "right") - 1
    content = span_hashes(values if units.words else byte_values(values), first, first + count + w - 1)
    return Supers(data, starts, ends, cuts, doc, first, first - cuts[doc], count, gram[at[first]], content)


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _by_content(s: Supers, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): super-windows ordered by content and owner; where a new content begins."""
    order = _order(s.content, ids[s.doc], s.local)
    c = s.content[order]
    heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    return order, heads


# --------------------------------------------------------------------- 1 and 2: which anchors repeat
def _anchor_keys(s: Supers, ids: np.ndarray, units: Units, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(composite keys, distinct and sorted: bucket and low hash bits; repeated within the block; inverse)."""
    key = ((s.anchor >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (s.anchor & _LOW)
    keys, inverse = np.unique(key, return_inverse=True)
    if units.within:
        again = np.bincount(inverse, minlength=len(keys)) > 1
    else:
        lo, hi = np.full(len(keys), 2**63 - 1), np.full(len(keys), -(2**63))
        np.minimum.at(lo, inverse, ids[s.doc])
        np.maximum.at(hi, inverse, ids[s.doc])
        again = lo != hi
    return keys, again, inverse


def _low(keys: np.ndarray, wide: bool) -> np.ndarray:
    """What is sent of composite keys: the home is a bucket, and four bytes tell its keys apart, or the home serves many and all is sent."""
    return keys.astype("<u8") if wide else (keys & _LOW).astype("<u4")


def _composite(buckets: list[int], sent: list[bytes], wide: bool) -> np.ndarray:
    """Composite keys again, of all messages end to end."""
    if wide:
        return np.concatenate([np.frombuffer(x, "<u8") for x in sent])
    return np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(buckets, sent, strict=True)])


def _anchor_messages(block: int, to: np.ndarray, low: np.ndarray, again: np.ndarray) -> pa.Table:
    """One row for each receiver in `to`, which is in order."""
    at = heads_of(to)
    end = np.append(at, len(to))[1:]
    return pa.table(
        {
            "bucket": pa.array(to[at], pa.int64()),
            "block": pa.array(np.full(len(at), block), pa.int64()),
            "keys": pa.array([low[a:b].tobytes() for a, b in zip(at, end, strict=True)], pa.binary()),
            "again": pa.array([np.packbits(again[a:b]).tobytes() for a, b in zip(at, end, strict=True)], pa.binary()),
        }
    )


def _send_anchors(units: Units, route: Route):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        s = supers_of(table["text"], units)
        keys, again, _ = _anchor_keys(s, ids_of(table["doc_id"]), units, route.buckets)
        home = route.home((keys >> np.uint64(32)).astype(np.int64))
        return _anchor_messages(key[0].as_py(), home, _low(keys, route.bands > 1), again)

    return run


def _merge_anchors(route: Route):
    """A band's distinct keys; one that two of its blocks sent is repeated."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = table["keys"].to_pylist()
        every = _composite([], parts, True)
        own = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p) // 8) for x, p in zip(table["again"].to_pylist(), parts, strict=True)])
        keys, inverse, times = np.unique(every, return_inverse=True, return_counts=True)
        again = (times > 1) | (np.bincount(inverse, weights=own, minlength=len(keys)) > 0)
        return _anchor_messages(key[0].as_py() * route.bands + key[1].as_py(), (keys >> np.uint64(32)).astype(np.int64), _low(keys, False), again)

    return run


def _spread_anchors(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    known = _composite(found["bucket"].to_pylist(), found["hits"].to_pylist(), False) if found.num_rows else np.zeros(0, np.uint64)
    hit = np.isin(np.concatenate(parts) if parts else known, known)
    cuts = np.cumsum([0, *map(len, parts)])
    keep = [i for i in range(len(parts)) if hit[cuts[i] : cuts[i + 1]].any()]
    return pa.table(
        {
            "block": table["block"].take(pa.array(keep, pa.int64())),
            "bucket": table["bucket"].take(pa.array(keep, pa.int64())),
            "hits": pa.array([parts[i][hit[cuts[i] : cuts[i + 1]]].tobytes() for i in keep], pa.binary()),
        }
    )


def _answer_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
    own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["again"].to_pylist(), parts, strict=True)]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    sorted_keys = every[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    sizes = np.diff(np.append(heads, len(every)))
    flag = (sizes > 1) | (np.maximum.reduceat(np.concatenate(own)[order], heads) > 0)
    hit = np.empty(len(every), bool)
    hit[order] = np.repeat(flag, sizes)
    cuts = np.cumsum([0, *map(len, parts)])
    keep = [i for i in range(len(parts)) if hit[cuts[i] : cuts[i + 1]].any()]
    return pa.table(
        {
            "block": table["block"].take(pa.array(keep, pa.int64())),
            "bucket": pa.array([key[0].as_py()] * len(keep), pa.int64()),
            "hits": pa.array([parts[i][hit[cuts[i] : cuts[i + 1]]].tobytes() for i in keep], pa.binary()),
        }
    )


# --------------------------------------------------------------------- 3: super-windows at repeated anchors
_OWNER = np.dtype([("doc", "<i8"), ("start", "<i8"), ("count", "<i4"), ("size", "<i4"), ("content", "<u8")])
_WIDE = np.dtype([*_OWNER.descr, ("bucket", "<i8")])  # on the way to a band's home, which serves many buckets
_RUN = np.dtype([("content", "<u8"), ("from", "<i4"), ("length", "<i4"), ("doc", "<i8"), ("start", "<i8")])
_SUPERS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("owner", pa.binary()), ("body", pa.binary())])


def _super_messages(block: int, to: np.ndarray, head: np.ndarray, body: np.ndarray, off: np.ndarray) -> pa.Table:
    """One row for each receiver in `to`, which is in order."""
    at = heads_of(to)
    end = np.append(at, len(to))[1:]
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.table(
        [
            pa.array(to[at], pa.int64()),
            pa.array(np.full(len(at), block), pa.int64()),
            pa.array([press(head[a:b].tobytes()) for a, b in zip(at, end, strict=True)], pa.binary()),
            pa.array([press(body[off[a] : off[b]].tobytes()) for a, b in zip(at, end, strict=True)], pa.binary()),
        ],
        schema=_SUPERS,
    )


def _send_supers(units: Units, route: Route):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not texts.num_rows or not hits.num_rows:
            return _SUPERS.empty_table()
        s, ids = supers_of(texts["text"], units), ids_of(texts["doc_id"])
        known = _composite(hits["bucket"].to_pylist(), hits["hits"].to_pylist(), route.bands > 1)
        key_of = ((s.anchor >> np.uint64(32)) % np.uint64(route.buckets) << np.uint64(32)) | (s.anchor & _LOW)
        order, heads = _by_content(s, ids)
        pick = order[heads]
        pick = pick[np.isin(key_of[pick], known)]
        bucket = (key_of[pick] >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        pick, bucket = pick[by], bucket[by]
        if not len(pick):
            return _SUPERS.empty_table()
        head = np.empty(len(pick), _WIDE if route.bands > 1 else _OWNER)
        head["doc"], head["start"], head["count"], head["content"] = ids[s.doc[pick]], s.local[pick], s.count[pick], s.content[pick]
        if route.bands > 1:
            head["bucket"] = bucket
        end = s.first[pick] + s.count[pick] + units.width - 1
        lo, hi = (s.starts[s.first[pick]], s.ends[end - 1]) if units.words else (s.first[pick], end)
        head["size"] = hi - lo
        body, off = gather(s.data, lo, hi)
        return _super_messages(key[0].as_py() if key[0] is not None else 0, route.home(bucket), head, body, off)

    return run


def _first_owners(head: np.ndarray) -> np.ndarray:
    """Of each content the row with its first owner, by content."""
    order = _order(head["content"], head["doc"], head["start"])
    return order[heads_of(head["content"][order])]


def _merge_supers(route: Route):
    """A band's distinct contents, each with its first owner there."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        head = np.concatenate([np.frombuffer(open_(x), _WIDE) for x in table["owner"].to_pylist()])
        body = np.frombuffer(b"".join(map(open_, table["body"].to_pylist())), np.uint8)
        off = np.concatenate([[0], np.cumsum(head["size"].astype(np.int64))])
        rep = _first_owners(head)
        rep = rep[np.argsort(head["bucket"][rep], kind="stable")]
        one, one_off = gather(body, off[:-1][rep], off[1:][rep])
        own = np.empty(len(rep), _OWNER)
        for name in _OWNER.names:
            own[name] = head[name][rep]
        return _super_messages(key[0].as_py() * route.bands + key[1].as_py(), head["bucket"][rep], own, one, one_off)

    return run


def _spread_supers(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
    """To each block what holds for its contents: the runs found, and all windows at the band's first owner.

    Whether an owner comes before a copy is decided where the runs are applied, copy by copy.
    """
    open_ = zstandard.ZstdDecompressor().decompress
    heads = [np.frombuffer(open_(x), _WIDE) for x in table["owner"].to_pylist()]
    if not heads:
        return pa.table({"block": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
    head = np.concatenate(heads)
    rep = _first_owners(head)
    own = np.zeros(len(rep), _RUN)
    own["content"], own["length"], own["doc"], own["start"] = (head[x][rep] for x in ("content", "count", "doc", "start"))
    run = np.concatenate([own, *(np.frombuffer(x, _RUN) for x in found["runs"].to_pylist())])
    run = run[np.argsort(run["content"], kind="stable")]
    at = heads_of(run["content"])
    times = np.diff(np.append(at, len(run)))
    of = np.searchsorted(head["content"][rep], head["content"])
    which = np.repeat(at[of], times[of]) + np.arange(times[of].sum()) - np.repeat(np.cumsum(times[of]) - times[of], times[of])
    cuts = np.concatenate([[0], np.cumsum(times[of])])[np.cumsum([0, *map(len, heads)])]
    run = run[which]
    return pa.table({"block": table["block"], "runs": pa.array([run[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})


def _resolve(units: Units, resolve: Callable):
    """resolve(body, offsets, counts, width) -> group number of every window, equal windows equal; -1: occurs once."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        heads = [np.frombuffer(open_(x), _OWNER) for x in table["owner"].to_pylist()]
        head = np.concatenate(heads)
        block = np.repeat(table["block"].to_numpy(), [len(x) for x in heads])
        body = np.frombuffer(b"".join(map(open_, table["body"].to_pylist())), np.uint8)
        off = np.concatenate([[0], np.cumsum(head["size"].astype(np.int64))])
        # one copy of each content, owned by its first owner in the corpus
        order = _order(head["content"], head["doc"], head["start"])
        c = head["content"][order]
        new = np.concatenate([[True], c[1:] != c[:-1]])
        of = np.empty(len(head), np.int64)
        of[order] = np.cumsum(new) - 1
        rep = order[new]
        # texts in the order of their owners: among equal windows the first in the index is the first in the corpus
        by = _order(head["doc"][rep], head["start"][rep])
        rep = rep[by]
        place = np.empty(len(rep), np.int64)
        place[by] = np.arange(len(rep))
        of = place[of]
        one, one_off = gather(body, off[:-1][rep], off[1:][rep])
        counts = head["count"][rep].astype(np.int64)
        group = resolve(one, one_off, counts, units.width)
        # first owner of every window
        base = np.concatenate([[0], np.cumsum(counts)])
        j = np.arange(base[-1]) - np.repeat(base[:-1], counts)
        doc = np.repeat(head["doc"][rep], counts)
        start = np.repeat(head["start"][rep], counts) + j
        best_doc, best_start = doc.copy(), start.copy()
        many = np.flatnonzero(group >= 0)
        if len(many):
            o = many[_order(group[many], doc[many], start[many])]
            g = group[o]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            lead = o[new][np.cumsum(new) - 1]
            best_doc[o], best_start[o] = doc[lead], start[lead]
        # for each copy that a block sent: its windows whose first owner comes before the copy's own owner, in runs
        n = head["count"].astype(np.int64)
        rows = np.repeat(np.arange(len(head)), n)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        at = base[of[rows]] + k
        bd, bs, od = best_doc[at], best_start[at], head["doc"][rows]
        sooner = (bd < od) | (bd == od) & (bs < head["start"][rows] + k) if units.within else bd < od
        rows, k, bd, bs = rows[sooner], k[sooner], bd[sooner], bs[sooner]
        if not units.within:
            bs = k
        if not len(rows):
            return pa.table({"block": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (k[1:] != k[:-1] + 1) | (bd[1:] != bd[:-1]) | (bs[1:] != bs[:-1] + 1)])
        at = np.flatnonzero(new)
        run = np.empty(len(at), _RUN)
        run["content"], run["from"], run["doc"], run["start"] = head["content"][rows[at]], k[at], bd[at], bs[at]
        run["length"] = np.diff(np.append(at, len(rows)))
        to = block[rows[at]]
        by = np.argsort(to, kind="stable")
        run, to = run[by], to[by]
        at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        return pa.table({"block": pa.array(to[at], pa.int64()), "runs": pa.array([run[a:b].tobytes() for a, b in zip(at, [*at[1:], len(to)], strict=True)], pa.binary())})

    return run


# --------------------------------------------------------------------- 4: apply
def covered(s: Supers, ids: np.ndarray, units: Units, runs: list[bytes]) -> np.ndarray:
    """Which units of the block a repeated window covers."""
    n = int(s.cuts[-1])
    order, heads = _by_content(s, ids)
    sizes = np.diff(np.append(heads, len(order)))
    rank = np.empty(len(order), np.int64)  # content number of each super-window
    rank[order] = np.repeat(np.arange(len(heads)), sizes)
    first = order[heads]
    own_doc, own_start = ids[s.doc], s.local
    lead_doc, lead_start = own_doc[first][rank], own_start[first][rank]
    mark = np.zeros(n + 1, np.int64)

    def cover(window_from: np.ndarray, windows: np.ndarray) -> None:
        np.add.at(mark, window_from, 1)
        np.add.at(mark, window_from + windows + units.width - 1, -1)

    # the same content starts earlier in this block
    sooner = (lead_doc < own_doc) | (lead_doc == own_doc) & (lead_start < own_start) if units.within else lead_doc < own_doc
    cover(s.first[sooner], s.count[sooner])
    # windows that start earlier elsewhere
    run = np.concatenate([np.frombuffer(x, _RUN) for x in runs]) if runs else np.zeros(0, _RUN)
    if len(run):
        contents = s.content[first]
        at = np.searchsorted(contents, run["content"])
        times = sizes[at]
        which = np.repeat(np.arange(len(run)), times)
        inst = order[np.repeat(heads[at], times) + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)]
        d, b, k, length = run["doc"][which], run["start"][which], run["from"][which].astype(np.int64), run["length"][which].astype(np.int64)
        if units.within:
            ok = (d < own_doc[inst]) | (d == own_doc[inst]) & (b < own_start[inst] + k)
        else:
            ok = d < own_doc[inst]
        cover(s.first[inst[ok]] + k[ok], length[ok])
    return np.cumsum(mark[:n]) > 0


def repeated(docs: DataFrame, id_col: str, text_col: str, units: Units, resolve: Callable, finish: Callable, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """finish(texts, super-windows, covered units) -> Arrow table of `schema`, once per block.

    columns: passed on as a struct `rest`, first in the result.
    """
    spark = docs.sparkSession
    base, total, blocks = blocks_of(docs, id_col, text_col, columns)
    density = 2 / (units.width - units.gram + 2)
    route = route_for(spark, total * density / (6 if units.words else 1), blocks)
    texts = base.groupBy("block")
    anchors = texts.applyInArrow(_send_anchors(units, route), "bucket long, block long, keys binary, again binary")
    hits = relay(anchors, route, _merge_anchors(route), _answer_anchors, _spread_anchors, "block long, bucket long, hits binary")
    supers = texts.cogroup(hits.groupBy("block")).applyInArrow(_send_supers(units, route), "bucket long, block long, owner binary, body binary")
    runs = relay(supers, route, _merge_supers(route), _resolve(units, resolve), _spread_supers, "block long, runs binary")

    def last(key: tuple[pa.Scalar, ...], table: pa.Table, found: pa.Table) -> pa.Table:
        s, ids = supers_of(table["text"], units), ids_of(table["doc_id"])
        out = finish(table, s, covered(s, ids, units, found["runs"].to_pylist()))
        return out.add_column(0, "rest", table["rest"]) if columns else out

    if columns:
        schema = T.StructType([base.schema["rest"], *schema.fields])

    return texts.cogroup(runs.groupBy("block")).applyInArrow(last, schema)


def run_spans(mask: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a cut: first and one past the last."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[cuts] = True
    before = np.concatenate([[False], mask[:-1]]) & ~edge[:-1]
    after = np.concatenate([mask[1:], [False]]) & ~edge[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
