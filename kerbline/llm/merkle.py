"""Operator 11: Merkle manifest of a dataset over a radix-ranked trie.

Exact places of rows in their group come from hierarchical histograms of the digits of their keys, not from a sort:
a cell is a prefix of the key (written in hex digits).  A cell with too many rows is cut by further digits, at most
65,536 ways at once; the digits that all its rows share are passed over.  A cell begins where its parent begins plus
the rows of earlier siblings, and a window over one cell of at most CELL_ROWS rows gives the places inside.

A place in base 16 is the key of a trie node: the children of a node differ in its last digit.  Nodes are reduced from
the longest prefix up, three digits (4,096 children's children) a pass, then what a node needs of the nodes above it
goes down the same way, so a proof is put together without a row for each of its siblings.

The leaf table (digests and keys, no texts) is written once in the shared checkpoint folder and ranked there; each row
has a number of its own in it, so repeated rows have an order too.  Groups are unbounded in size and number: a hot
group, a hot id and copies of one row are cut like all else, and the groups' own roots are ranked and folded by the
same two functions.

Edge cases: null ids come before every id, a null source before every source; rows that share source and id go by
their leaf, equal leaves are interchangeable; a lone leaf is its group's root and a lone group's root the root (no
siblings: the proof is the digest of nothing); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Children of a trie node.
FANOUT = 16
#: Digits that one pass reduces: a task's group holds up to FANOUT ** DIGITS nodes.
DIGITS = 3
#: Rows that a cell of the histogram holds at most; and digits by which a cell is cut at once.
CELL_ROWS = FANOUT**DIGITS
MOST_DIGITS = 4
#: Cells up to which a list of them, two short strings and a number each, is sent to every task; more are joined.
BROADCAST_CELLS = 50_000


# --------------------------------------------------------------------- leaves
def encoded(value: Column) -> Column:
    """`-` for null, else the bytes of the value as text, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lowercase hex digest of the encoded values, one after the other."""
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def id_key(value: Column) -> Column:
    """Hex digits in the order of a 64-bit integer, null first."""
    number = value.cast("long")
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")), F.lit("0" * 17))


def text_key(value: Column) -> Column:
    """Hex digits in the bytewise order of a string, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.hex(value.cast("string").cast("binary"))), F.lit("0"))


# --------------------------------------------------------------------- exact ranks by digits
def _depth(low: str, high: str, rows: str) -> Column:
    """How many digits cut a cell of `rows` keys between low and high into cells of about CELL_ROWS, for even keys."""
    digits = f"greatest(length({low}), length({high}))"
    shared = f"coalesce(try_element_at(filter(sequence(1, {digits}), i -> substring({low}, i, 1) <> substring({high}, i, 1)), 1) - 1, {digits})"
    at = f"conv(rpad(substring({{0}}, shared + 1, {MOST_DIGITS}), {MOST_DIGITS}, '0'), 16, 10)"
    # cells at depth d below the shared digits: how many numbers of d digits lie between the two
    between = f"cast({at.format(high)} as long) div w - cast({at.format(low)} as long) div w + 1"
    widths = ", ".join(f"{FANOUT ** (MOST_DIGITS - d)}L" for d in range(1, MOST_DIGITS + 1))
    need = f"filter(array({widths}), w -> {rows} <= {CELL_ROWS // 2} * ({between}))"
    more = f"coalesce({MOST_DIGITS} - cast(round(log({FANOUT}, try_element_at({need}, 1))) as int), {MOST_DIGITS})"
    return F.expr(more.replace("shared", f"({shared})") + f" + ({shared})")


def radix_ranks(rows: DataFrame, group: str, key: str, tie: str) -> DataFrame:
    """`rows` with `place`, the exact number from 0 of a row among those of its group by key and then tie, and `n`, the group's rows.

    key and tie: strings of hex digits; a pair is not repeated in a group.  rows should be a written table.
    """
    at = rows.withColumn("digits", F.concat(F.col(key), F.lit("/"), F.col(tie))).withColumn("cell", F.lit(""))
    counted = [F.count("*").alias("rows"), F.min("digits").alias("low"), F.max("digits").alias("high")]
    cells = cut(at.groupBy(group, "cell").agg(*counted).withColumn("first", F.lit(0).cast("long")).withColumn("n", F.col("rows")))
    closed = []
    while True:
        closed.append(cells.where(F.col("rows") <= CELL_ROWS).select(group, "cell", "first", "n"))
        large = cut(cells.where(F.col("rows") > CELL_ROWS).select(F.col(group).alias("of"), F.col("cell").alias("parent"), "first", "n", _depth("low", "high", "rows").alias("depth")))
        parents = large.count()
        if not parents:
            break
        # rows of closed cells keep theirs; parents are few, one for CELL_ROWS rows at most
        depths = large.select("of", "parent", "depth")
        at = at.join(F.broadcast(depths) if parents <= BROADCAST_CELLS else depths, (F.col(group) == F.col("of")) & (F.col("cell") == F.col("parent")), "left")
        inner = at.where(F.col("depth").isNotNull()).groupBy(group, "parent", F.expr("substring(digits, 1, depth)").alias("cell")).agg(*counted)
        at = at.withColumn("cell", F.expr("if(depth is null, cell, substring(digits, 1, depth))")).drop("of", "parent", "depth")
        siblings = inner.join(large.select("of", F.col("parent").alias("within"), F.col("first").alias("begins"), "n"), (F.col(group) == F.col("of")) & (F.col("parent") == F.col("within")))
        before = F.expr(f"coalesce(sum(rows) over (partition by {group}, parent order by cell rows between unbounded preceding and 1 preceding), 0L)")
        cells = cut(siblings.select(group, "cell", "rows", "low", "high", (F.col("begins") + before).alias("first"), "n"))
    known = closed[0]
    for more in closed[1:]:
        known = known.unionByName(more)
    known = known.withColumnsRenamed({group: "of", "cell": "within"})
    inside = F.expr(f"row_number() over (partition by {group}, cell order by digits)")
    ranked = at.join(known, (F.col(group) == F.col("of")) & (F.col("cell") == F.col("within")))
    return ranked.withColumn("place", F.col("first") + inside - 1).select(*rows.columns, "place", "n")


# --------------------------------------------------------------------- trie
def levels(n: int) -> int:
    """Rounds in which n nodes become one."""
    out = 0
    while FANOUT**out < n:
        out += 1
    return out


def _hex(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _reduce(nodes: list[str], rounds: int) -> list[list[str]]:
    """The nodes of every level, the given ones first."""
    out = [nodes]
    for _ in range(rounds):
        below = out[-1]
        out.append([_hex(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _rounds(n: int, level: int) -> int:
    """Levels that a pass starting at `level` reduces in a group of n leaves."""
    return max(0, min(DIGITS, levels(n) - level))


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def fold(nodes: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """(group, root of each group; group, leaf block, above): nodes have group, place, n and digest.

    `above` holds, for the leaves block * 4,096 to block * 4,096 + 4,095, what stands left and right of the block's
    node on every level from the block's up to the root, as one string each.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    kept, passes = [], max(1, math.ceil(levels(most) / DIGITS))
    kind = nodes.schema[group].dataType.simpleString()
    now = nodes.select(group, "place", "n", "digest").withColumn("block", F.shiftright("place", 4 * DIGITS))
    for p in range(passes):
        kept.append(now)
        reduced = cut(now.groupBy(group, "block").applyInArrow(_up(group, p * DIGITS), f"{group} {kind}, place long, n long, digest string"))
        now = reduced.withColumn("block", F.shiftright("place", 4 * DIGITS))
    roots = now.select(group, F.col("digest").alias("root"))
    above = now.select(group, F.col("place").alias("block"), F.lit(None).cast(_SIDES).alias("above"))
    for p in range(passes - 1, 0, -1):
        above = (
            kept[p]
            .groupBy(group, "block")
            .cogroup(above.groupBy(group, "block"))
            .applyInArrow(_down(group, p * DIGITS), f"{group} {kind}, block long, above {_SIDES}")
        )
    return roots, above


def _up(group: str, level: int):
    """A block of nodes of that level becomes the node of DIGITS levels above."""

    def work(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        n = table["n"][0].as_py()
        top = _reduce(table["digest"].to_pylist(), _rounds(n, level))[-1]
        return pa.table({group: table[group][:1], "place": table["block"][:1], "n": pa.array([n], pa.int64()), "digest": pa.array(top, pa.string())})

    return work


_SIDES = "array<struct<left: string, right: string>>"
_SIDES_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _down(group: str, level: int):
    """What stands beside every node of a block of that level, and beside the block's own node."""

    def work(key, table: pa.Table, over: pa.Table) -> pa.Table:
        table, sides = _beside(table, over, level)
        return pa.table({group: table[group], "block": table["place"], "above": sides})

    return work


def _beside(table: pa.Table, over: pa.Table, level: int) -> tuple[pa.Table, pa.Array]:
    table = _ordered(table)
    rest = (over["above"][0].as_py() or []) if over.num_rows else []
    rows = _reduce(table["digest"].to_pylist(), _rounds(table["n"][0].as_py(), level))
    sides = [[{"left": a, "right": b} for a, b in _sides(rows, i)] + rest for i in range(table.num_rows)]
    return table, pa.array(sides, _SIDES_ARROW)


def _sides(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Left and right siblings of node i of the first of `rows`, level by level."""
    out = []
    for level in rows[:-1]:
        a = i - i % FANOUT
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + FANOUT])))
        i //= FANOUT
    return out


def manifest(
    docs: DataFrame,
    leaf_digest: Column,
    presented: Column,
    group_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (digest of the row's siblings up to the root), folded_root, verified.

    leaf_digest: what the trie is made of; presented: the digest that is put to the test with the row's proof.
    folded_root is what the presented digest and the leaf's siblings give; verified if that is the root.
    """
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(F.col(group_col)).alias("of_group"),
        id_key(F.col(id_col)).alias("key"),
        F.unhex(leaf_digest).alias("own_leaf"),
        F.unhex(presented).alias("shown"),
    )
    # written once: copies of a row are told apart by their number in the written table
    own = cut(own.withColumn("number", F.monotonically_increasing_id()))
    tie = F.concat(F.lower(F.hex("own_leaf")), F.lpad(F.lower(F.hex("number")), 16, "0"))
    ranked = cut(radix_ranks(own.withColumn("tie", tie), "of_group", "key", "tie").select("doc_id", "of_group", "place", "n", "own_leaf", "shown"))
    subroots, above = fold(ranked.withColumn("digest", F.lower(F.hex("own_leaf"))), "of_group")
    groups = cut(subroots.select("of_group", "root", F.col("of_group").alias("key"), F.lit("").alias("whole"), F.lit("").alias("tie")))
    ordered = cut(radix_ranks(groups, "whole", "key", "tie").select("whole", "of_group", "place", "n", F.col("root").alias("digest")))
    root, over = fold(ordered, "whole")
    # what the groups' trie adds to every row's proof: one row a group
    tops = ordered.withColumn("block", F.shiftright("place", 4 * DIGITS)).groupBy("whole", "block").cogroup(over.groupBy("whole", "block")).applyInArrow(_tops, f"of_group string, subroot string, tops {_SIDES}")
    top = root.first()  # one digest
    blocks = above.join(tops, "of_group").select("of_group", "block", "subroot", F.lit(top and top["root"]).alias("root"), F.expr("concat(coalesce(above, array()), tops)").alias("above"))
    leaves = ranked.withColumn("block", F.shiftright("place", 4 * DIGITS))
    schema = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    return leaves.groupBy("of_group", "block").cogroup(blocks.groupBy("of_group", "block")).applyInArrow(_prove, schema)


def _tops(key, table: pa.Table, over: pa.Table) -> pa.Table:
    table, sides = _beside(table, over, 0)
    return pa.table({"of_group": table["of_group"], "subroot": table["digest"], "tops": sides})


def _prove(key, table: pa.Table, over: pa.Table) -> pa.Table:
    table = _ordered(table)
    leaves, shown = ([x.hex() for x in table[c].to_pylist()] for c in ("own_leaf", "shown"))
    subroot, root = over["subroot"][0].as_py(), over["root"][0].as_py()
    rest = [(s["left"], s["right"]) for s in over["above"][0].as_py()]
    rows = _reduce(leaves, _rounds(table["n"][0].as_py(), 0))
    tail = "".join(a + b for a, b in rest).encode()
    proofs, folded = [], []
    for i, (own, other) in enumerate(zip(leaves, shown, strict=True)):
        sides = _sides(rows, i)
        digest = hashlib.sha256("".join(a + b for a, b in sides).encode())
        digest.update(tail)
        proofs.append(digest.hexdigest())
        for left, right in [*sides, *rest]:
            other = hashlib.sha256(f"{left}{other}{right}".encode()).hexdigest()
        folded.append(other)
    n = len(leaves)
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "leaf": pa.array(leaves, pa.string()),
            "subroot": pa.array([subroot] * n, pa.string()),
            "root": pa.array([root] * n, pa.string()),
            "proof": pa.array(proofs, pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array(np.array(folded, object) == root if n else [], pa.bool_()),
        }
    )
