"""Operator 5: MinHash near-dedup with an LSH forest.

Every distinct shingle set gets TREES x DEPTH minimum hashes.  Each tree is one order of the signatures:
rows sorted by its DEPTH hashes.  Neighbours in that order whose longest common prefix reaches the depth of
their region are candidates.  A region's depth adapts to how many rows share its prefix, between SHALLOW and
DEPTH hashes: at the threshold similarity 0.85 a link is missed by all trees with probability under
(1 - 0.85 ** DEPTH) ** TREES, about 8e-7, in the densest regions and under 1e-8 in the others.

Candidates that hang together form candidate groups; inside those, links are confirmed on the full sets:
intersections of all members are counted exactly by products of set matrices.  A group too large for one
task is cut into chunks, so no cap on candidates is needed.  First every chunk is held against the group's
first one, which is linear in the group.  Links inside a component that this confirms change nothing any more,
so only members outside the group's largest component are then held against all its chunks.  A task answers
with a spanning forest, never with all pairs.  Copies (equal sets) are one row until the end.  What stays quadratic
is a large group of candidates of which few are linked, such as forms filled in differently: its members outside the
largest component are held against the whole group, in blocks.

Edge cases: texts that are null or have no word have an empty set, are linked with nothing and keep
themselves; fewer words than a shingle give one shingle of all words; a null id comes before every id and
comes back as null; rows that share an id are separate documents with the same name; empty tables give
empty results; other columns are not read.  Shingles are told apart by 64-bit hashes inside a document or group,
sets by 128-bit sums of them and their size; distinct sets are numbered, not hashed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, batches, buffers, claim, cut, lower_ascii, mix, release, shuffle_partitions, small_batches, span_hashes, span_keys, word_spans
from .components import connected_components

#: Orders of the signatures, hashes in each, and hashes that neighbours share at least.
TREES, DEPTH, SHALLOW = 24, 5, 3
#: Rows of a region from which it takes a deeper prefix.
REGION = 64
#: Rows that a part of an order holds on average.
PART_ROWS = 500_000
#: Documents and shingles of a chunk of a candidate group.
CHUNK_DOCS, CHUNK_SHINGLES = 256, 200_000

_rng = np.random.default_rng(5)
_A = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted; offsets)."""
    claim("near_dedup")
    data, off = buffers(column)
    data = lower_ascii(data)
    starts, ends, cuts = word_spans(data, off)
    words = span_keys(data, starts, ends)[0]
    n = np.diff(cuts)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = cuts[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    hashes = span_hashes(words, first, np.minimum(first + width, cuts[doc + 1]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(width: int, extra: bool = False):
    def run(stream):
        for table in batches(stream, "text"):
            hashes, off = shingle_sets(table["text"], width)
            size = np.diff(off)
            some = np.flatnonzero(size)
            at = off[:-1][some]
            sums = [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
            sig = np.zeros((len(size), TREES * DEPTH), ">u4")
            if len(some):
                sums[0][some] = np.add.reduceat(mix(hashes), at)
                sums[1][some] = np.add.reduceat(mix(hashes ^ _B[0]), at)
                for j in range(TREES * DEPTH):
                    sig[some, j] = np.minimum.reduceat(hashes * _A[j] + _B[j], at) >> np.uint64(32)
            raw = sig.tobytes()
            step = 4 * TREES * DEPTH
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": table["doc_id"],
                    "n": pa.array(size, pa.int64()),
                    "set1": pa.array((sums[0] + mix(sums[1])).view(np.int64), pa.int64()),
                    "set2": pa.array(sums[1].view(np.int64), pa.int64()),
                    "signature": pa.array([raw[i * step : (i + 1) * step] for i in range(len(size))], pa.binary()),
                }
                | ({"rest": table["rest"]} if extra else {})
            )

    return run


# --------------------------------------------------------------------- candidates
def _tree_rows(stream):
    width = 4 * DEPTH
    for batch in stream:
        sig = batch["signature"].to_pylist()
        node = np.repeat(batch["node"].to_numpy(), TREES)
        keys = [bytes([t]) + s[t * width : (t + 1) * width] for s in sig for t in range(TREES)]
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "node": pa.array(node, pa.int64())})


def _linked(key: np.ndarray) -> np.ndarray:
    """Whether each sorted row is a candidate neighbour of the row before it.  key: (rows, 1 + DEPTH) tree number and hashes."""
    n = len(key)
    same = np.logical_and.accumulate(key[1:] == key[:-1], axis=1)  # same[:, d]: tree and the first d hashes agree
    linked = np.zeros(n, bool)
    settled = np.zeros(n, bool)
    for depth in range(SHALLOW, DEPTH + 1):
        agree = np.concatenate([[False], same[:, depth]])
        run = np.cumsum(~agree) - 1
        dense = np.bincount(run)[run] > REGION
        use = ~settled & (~dense if depth < DEPTH else True)
        linked |= use & agree
        settled |= use
    return linked


def _neighbours(stream):
    """Star edges of the runs of neighbours in one part of an order, and the part's first and last row."""
    part = TaskContext.get().partitionId()
    parts = [(b["key"], b["node"]) for b in stream if b.num_rows]
    if not parts:
        return
    raw = pa.chunked_array([k for k, _ in parts]).to_pylist()
    node = np.concatenate([x.to_numpy(zero_copy_only=False) for _, x in parts])
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    key = np.concatenate([flat[:, :1].astype(np.uint32), np.ascontiguousarray(flat[:, 1:]).view(">u4").astype(np.uint32)], axis=1)
    linked = _linked(key)
    run = np.cumsum(~linked) - 1
    head = np.flatnonzero(~linked)
    low = np.minimum.reduceat(node, head)[run]
    out = np.flatnonzero(low != node)
    edges = np.unique(np.stack([node[out], low[out]], axis=1), axis=0)
    m = len(edges)
    yield pa.RecordBatch.from_pydict(
        {
            "u": pa.array([*edges[:, 0].tolist(), int(node[0]), int(node[-1])], pa.int64()),
            "v": pa.array([*edges[:, 1].tolist(), 0, 0], pa.int64()),
            "end": pa.array([None] * m + [2 * part, 2 * part + 1], pa.int64()),
            "key": pa.array([None] * m + [raw[0], raw[-1]], pa.binary()),
        }
    )


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """(u, v): edges that hold every candidate region together.  nodes: (node, signature)."""
    spark = nodes.sparkSession
    rows = nodes.select("node", "signature").mapInArrow(_tree_rows, "key binary, node long")
    # equal keys are parted by their nodes, so no part outgrows its task
    parts = max(shuffle_partitions(spark), math.ceil(nodes.count() * TREES / PART_ROWS))
    ordered = rows.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    found = cut(ordered.mapInArrow(_neighbours, "u long, v long, end long, key binary"))
    # where an order is cut between two tasks: two rows per task come here, whatever the size of the table
    ends = sorted((r.end, bytes(r.key), r.u) for r in found.where("end is not null").collect())
    seams = []
    for (_, a, u), (_, b, v) in zip(ends[1::2], ends[2::2], strict=False):
        if a[: 1 + 4 * SHALLOW] == b[: 1 + 4 * SHALLOW] and u != v:
            seams.append((u, v))
    edges = found.where("end is null").select("u", "v")
    return edges.unionAll(spark.createDataFrame(seams, "u long, v long")) if seams else edges


# --------------------------------------------------------------------- confirmation
def _links(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """Root (smallest place) of each set's component under 100 * intersection >= percent * union.

    split: with two chunks, where the second begins; links inside a chunk are then found by another task.
    """
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    s, o = every[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    column = np.cumsum(shared) - 1
    keep = shared[number]
    col, row = column[number[keep]], o[keep]
    inter = np.zeros((n, n) if split is None else (split, n - split), np.float64)
    columns = int(shared.sum())
    step = min(max(256, 8_000_000 // max(1, n)), max(1, columns))
    for a in range(0, columns, step):
        lo, hi = np.searchsorted(col, (a, a + step))
        dense = np.zeros((n, step), np.float32)
        dense[row[lo:hi], col[lo:hi] - a] = 1
        inter += dense @ dense.T if split is None else dense[:split] @ dense[split:].T
    if split is None:
        near = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    else:
        near = np.zeros((n, n), bool)
        near[:split, split:] = 100 * inter >= percent * (size[:split, None] + size[None, split:] - inter)
        near |= near.T
    root = np.full(n, -1)
    for i in range(n):
        if root[i] < 0:
            todo = [i]
            root[i] = i
            while todo:
                more = np.flatnonzero(near[todo].any(axis=0) & (root < 0))
                root[more] = i
                todo = more.tolist()
    return root


def _edges(nodes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = np.flatnonzero(root != np.arange(len(root)))
    return nodes[out], nodes[root[out]]


def _confirm_groups(width: int, percent: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = table["root"].to_numpy()
        order = np.argsort(group, kind="stable")
        hashes, off = shingle_sets(table["text"].take(pa.array(order)), width)
        node, group = table["node"].to_numpy()[order], group[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            u, v = _edges(node[a:b], _links([hashes[off[i] : off[i + 1]] for i in range(a, b)], percent))
            us.append(u)
            vs.append(v)
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    return run


def _pack_chunk(width: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hashes, off = shingle_sets(table["text"], width)
        return pa.table(
            {
                "root": pa.array([key[0].as_py()], pa.int64()),
                "chunk": pa.array([key[1].as_py()], pa.int64()),
                "chunks": pa.array([table["chunks"][0].as_py()], pa.int64()),
                "nodes": pa.array([table["node"].to_numpy().tobytes()], pa.binary()),
                "offsets": pa.array([off.astype(np.int64).tobytes()], pa.binary()),
                "hashes": pa.array([hashes.tobytes()], pa.binary()),
            }
        )

    return run


def _confirm_pair(percent: int, across: bool):
    """Links between two chunks; across: those inside either chunk don't matter."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes, sets, split = [], [], None
        for r in table.to_pylist():
            off, h = np.frombuffer(r["offsets"], np.int64), np.frombuffer(r["hashes"], np.uint64)
            split = (len(sets) or None) if across else None
            nodes.append(np.frombuffer(r["nodes"], np.int64))
            sets += [h[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        u, v = _edges(np.concatenate(nodes), _links(sets, percent, split))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, columns: list[str] | None = None) -> DataFrame:
    """Link documents whose sets of `width`-word shingles have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles, component_id (smallest id reachable) and component (a number of its own for each
    component, null for an empty set) for every document, and a struct `rest` of `columns`, if these are given.
    Ids need not be unique: components tell rows that share an id apart, component_id doesn't.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.struct(*columns).alias("rest")) if columns else own
    kind = ", rest " + whole.schema["rest"].dataType.simpleString() if columns else ""
    signed = cut(whole.mapInArrow(_signatures(width, bool(columns)), f"doc_id long, n long, set1 long, set2 long, signature binary{kind}"))
    order = F.coalesce(F.col("doc_id"), F.lit(NULL_ID))
    # copies are one node, numbered where the table is written
    nodes = cut(
        signed.where("n > 0").groupBy("n", "set1", "set2").agg(F.min(order).alias("rep"), F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id())
    )
    groups = connected_components(candidate_edges(nodes))
    members = cut(groups.join(nodes.select("node", "rep", "n", "set1", "set2"), "node"))
    del groups
    release(spark)
    sizes = cut(members.groupBy("root").agg(_chunks().alias("chunks")))
    reps = own.select(order.alias("rep"), "text")
    # one text per node: rows that share an id may hold several sets, so the set decides
    texts = cut(members.join(sizes, "root").join(reps, "rep").mapInArrow(_own_text(width), "root long, chunks long, node long, n long, text string"))
    total = members.agg(F.sum("n")).first()[0] or 0
    bins = max(2 * shuffle_partitions(spark), math.ceil(total / CHUNK_SHINGLES))
    small = (
        texts.where("chunks <= 1")
        .select(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"), "root", "node", "text")
        .groupBy("bin")
        .applyInArrow(_confirm_groups(width, percent), "u long, v long")
    )
    if sizes.where("chunks > 1").isEmpty():
        linked = connected_components(small).withColumnRenamed("root", "top")
    else:
        packed = cut(_packed(texts.where("chunks > 1"), width))
        star = _star(packed).groupBy("root", "other").applyInArrow(_confirm_pair(percent, False), "u long, v long")
        linked = cut(connected_components(small.unionAll(star)).withColumnRenamed("root", "top"))
        rest = _outliers(texts, packed, linked, width, percent)
        if rest is not None:
            linked = connected_components(linked.where("node != top").select(F.col("node").alias("u"), F.col("top").alias("v")).unionAll(rest)).withColumnRenamed("root", "top")
        del packed, star, rest
    del texts, small, members, sizes
    release(spark)
    labels = linked.join(nodes.select("node", "rep"), "node")
    tops = labels.groupBy("top").agg(F.min("rep").alias("component"))
    label_of = cut(nodes.select("set1", "set2", "n", "node", "rep").join(linked, "node", "left").join(tops, "top", "left").select("set1", "set2", "n", F.coalesce("component", "rep").alias("smallest"), F.coalesce("top", "node").alias("component")))
    rest = ["rest"] if columns else []
    found = signed.select("doc_id", "n", "set1", "set2", *rest).join(label_of, ["n", "set1", "set2"], "left")
    smallest = F.coalesce("smallest", order)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(smallest != NULL_ID, smallest).alias("component_id"), "component", *rest)


def _chunks():
    return F.ceil(F.greatest(F.count("*") / CHUNK_DOCS, F.sum("n") / CHUNK_SHINGLES)).cast("long")


def _packed(texts: DataFrame, width: int) -> DataFrame:
    """A row for each chunk of each group: its nodes and their sets."""
    return (
        texts.select("root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).alias("chunk"), "chunks", "node", "text")
        .groupBy("root", "chunk")
        .applyInArrow(_pack_chunk(width), "root long, chunk long, chunks long, nodes binary, offsets binary, hashes binary")
    )


def _star(packed: DataFrame) -> DataFrame:
    """Every chunk beside the first one of its group, `other` being its own number."""
    first = F.when(F.col("chunk") == 0, F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    return packed.select("root", F.explode(first).alias("other"), "nodes", "offsets", "hashes")


def _outliers(texts: DataFrame, packed: DataFrame, linked: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links of members outside the largest component of their group, held against all its chunks but the first; None if there are no such members."""
    large = cut(texts.where("chunks > 1").select("root", "chunks", "node", "n").join(linked, "node", "left").withColumn("top", F.coalesce("top", "node")))
    main = large.groupBy("root", "top").count().groupBy("root").agg(F.max_by("top", F.struct("count", "top")).alias("main"))
    outside = cut(large.join(cut(main), "root").where("top != main").select("root", "node", "n"))
    if outside.isEmpty():
        return None
    sizes = cut(outside.groupBy("root").agg(_chunks().alias("apart")))
    own = outside.join(sizes, "root").select(F.col("node").alias("_node"), F.col("apart").alias("chunks"))
    theirs = texts.where("chunks > 1").drop("chunks").join(own, F.col("node") == F.col("_node"))
    asks = cut(_packed(theirs, width)).join(packed.select("root", F.col("chunks").alias("whole")).distinct(), "root")
    body = ("nodes", "offsets", "hashes")
    pairs = asks.select("root", F.col("chunk").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole") - 1)).alias("b"), *body).unionAll(
        packed.where("chunk > 0").join(sizes, "root").select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("apart") - 1)).alias("a"), F.col("chunk").alias("b"), *body)
    )
    return pairs.groupBy("root", "a", "b").applyInArrow(_confirm_pair(percent, True), "u long, v long")


def _own_text(width: int):
    def run(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            for table in batches([batch], "text"):
                hashes, off = shingle_sets(table["text"], width)
                some = np.flatnonzero(np.diff(off))
                key1, key2 = np.zeros(table.num_rows, np.uint64), np.zeros(table.num_rows, np.uint64)
                if len(some):
                    key1[some] = np.add.reduceat(mix(hashes), off[:-1][some])
                    key2[some] = np.add.reduceat(mix(hashes ^ _B[0]), off[:-1][some])
                mine = (np.diff(off) == table["n"].to_numpy()) & ((key1 + mix(key2)).view(np.int64) == table["set1"].to_numpy()) & (key2.view(np.int64) == table["set2"].to_numpy())
                kept = table.filter(pa.array(mine))
                yield pa.RecordBatch.from_pydict({c: kept[c] for c in ("root", "chunks", "node", "n", "text")})

    return run
