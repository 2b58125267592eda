"""Linked tables: rows that name their predecessor and successor are numbered along their lists without any other order.

Numbering is list ranking by pointer doubling: each row knows a row before it and how far that is; a round replaces it by
that row's own, so a list of n rows takes log2(n) joins.  Rows that have come to the head of their list leave the
rounds, and the others look at different rows each, so no key is hot however long a list is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions import geometry as geo
from kerbline.session import cut

#: Rows of a list that one window task holds; rows near the border of a stretch are in both.
STRETCH = 4096


def rank_lists(rows: DataFrame, token: str = "token", prev: str = "prev") -> DataFrame:
    """token, head (first row of its list), idx (from 0) and cyclic (null head and idx) for every row.

    A predecessor that is null, empty or not in the table is none: a list begins there.  Rows whose predecessors lead
    into a cycle are cyclic; a row that is its own predecessor is a cycle.  Several rows may name one predecessor: the
    lists that branch share their first rows, numbered alike.  Tokens are unique.
    """
    own = rows.select(F.col(token).alias("token"), F.nullif(F.col(prev), F.lit("") if dict(rows.dtypes)[prev] == "string" else F.lit(None)).alias("up"))
    known = own.select(F.col("token").alias("there"))
    linked = own.join(known, F.col("up") == F.col("there"), "left").select("token", F.col("there").alias("up"))
    # up: the row `steps` before; done: up is the head
    done = F.col("up").isNull()
    now = cut(linked.select("token", F.coalesce("up", "token").alias("up"), F.when(done, 0).otherwise(1).cast("long").alias("steps"), done.alias("done")))
    n, longest = now.count(), 1
    while longest <= 2 * n and not now.where("not done").isEmpty():
        ahead = now.select(F.col("token").alias("at"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("done").alias("arrived"))
        moved = now.where("not done").join(ahead, F.col("up") == F.col("at"))
        now = cut(now.where("done").unionByName(moved.select("token", F.col("further").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("arrived").alias("done"))))
        longest *= 2
    return now.select("token", F.when(F.col("done"), F.col("up")).alias("head"), F.when(F.col("done"), F.col("steps")).alias("idx"), (~F.col("done")).alias("cyclic"))


def along_lists(rows: DataFrame, back: int, ahead: int, values: list[str], head: str = "head", idx: str = "idx") -> DataFrame:
    """Rows with `before` (1 to back) and `after` (1 to ahead) places along their list: arrays of structs of values, nearest first, nulls beyond the ends.

    Lists are cut into stretches of STRETCH rows; rows within reach of a border are given to both, so a list that holds
    a third of all rows is many tasks.
    """
    reach = max(back, ahead)
    if reach >= STRETCH:
        raise ValueError("the reach is longer than a stretch")
    home = F.floor(F.col(idx) / STRETCH)
    inside = F.col(idx) % STRETCH
    also = F.array_compact(F.array(home, F.when((inside < reach) & (home > 0), home - 1), F.when(inside >= STRETCH - reach, home + 1)))
    spread = rows.withColumn("_stretch", F.explode(also))
    w = Window.partitionBy(head, "_stretch").orderBy(idx)
    value = F.struct(*values)
    seen = lambda k: F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
    out = spread.select(
        "*",
        F.array(*[seen(k) for k in range(1, back + 1)]).alias("before"),
        F.array(*[seen(-k) for k in range(1, ahead + 1)]).alias("after"),
    )
    return out.where(F.col("_stretch") == F.floor(F.col(idx) / STRETCH)).drop("_stretch")


def history_and_future(rows: DataFrame, back: int, ahead: int, x: str = "x", y: str = "y", heading: str = "heading") -> DataFrame:
    """Trajectories in the row's own frame: `past` (oldest first, the row last), `future` (the row first), n_past and n_future real points.

    Where the list has no earlier row, the motion of its first row to the next goes on backwards; where it has no later
    row, the last one stands still.
    """
    placed = along_lists(rows, back, max(ahead, 1), [x, y])
    here = F.struct(F.col(x).alias(x), F.col(y).alias(y))
    known = F.filter("before", lambda p: p.isNotNull())
    follow = F.filter(F.slice("after", 1, ahead), lambda p: p.isNotNull())
    real = F.concat(F.array(here), known)  # nearest first
    first, n = F.element_at(real, -1), F.size(real)
    # what comes after the first row of the list: the row before it in `real`, or the next one
    second = F.when(n > 1, F.get(real, n - 2)).otherwise(F.get("after", F.lit(0)))
    step = {c: F.coalesce(second.getField(c) - first.getField(c), F.lit(0.0)) for c in (x, y)}
    sized = placed.select("*", real.alias("_real"), follow.alias("_follow"), first.alias("_first"), n.alias("_n"), step[x].alias("_dx"), step[y].alias("_dy"))
    missing = F.when(F.col("_n") <= back, F.sequence(F.lit(1), back + 1 - F.col("_n"))).otherwise(F.array().cast("array<int>"))
    made = F.transform(missing, lambda k: F.struct((F.col("_first").getField(x) - k * F.col("_dx")).alias(x), (F.col("_first").getField(y) - k * F.col("_dy")).alias(y)))
    last = F.element_at(F.concat(F.array(here), F.col("_follow")), -1)
    future = F.concat(F.array(here), F.col("_follow"), F.array_repeat(last, ahead - F.size("_follow")))
    past = F.reverse(F.concat(F.col("_real"), made))

    def local(points: Column) -> Column:
        def turned(p: Column) -> Column:
            px, py, _ = geo.to_local(p.getField(x), p.getField(y), F.col(heading), F.col(x), F.col(y), F.col(heading))
            return F.struct(px.alias("x"), py.alias("y"))

        return F.transform(points, turned)

    return sized.select(*rows.columns, local(past).alias("past"), local(future).alias("future"), F.col("_n").alias("n_past"), (F.size("_follow") + 1).alias("n_future"))
