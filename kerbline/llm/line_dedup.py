"""Operator 3: line dedup by prefix doubling over line-id sequences, in DataFrame operations only.

A document is its sequence of lines that are not blank; the suffixes of all documents are ordered by doubling.  Places
are numbered through the corpus, by document and line.  The rank of a place at depth 1 is the first place that holds the
same line; at depth 2, 4, 8, ... it is the first place whose pair of ranks, here and half the depth further on, is the
same.  Equal ranks mean equal lines, so places of one rank are one interval of suffixes with a common prefix of that
depth.  A place whose rank no other place shares is finished and leaves, so each round only carries what still repeats.

A run counts if it has `min_lines` lines that are not blank and `min_chars` characters in all.  Every copied run that
counts is covered by *least* runs: those that can't lose their last line, and those that can't lose their first, and
still count.  A least run of n lines is named by two ranks at the depth of the largest power of two in n, at its begin
and flush with its end (one rank if n is that power), so doubling ends at the longest least run; deeper common prefixes
would only name unions of least runs.  Per name the first place stays, later places are copies, and neighbouring copies
are glued to the maximal repeated runs, which are deleted.

Names are exchanged with partial counts; the join that brings a name's first place back is between two plain exchanges,
so adaptive execution splits a line that a third of all rows hold.  Lines are told apart by two 64-bit hashes.

Edge cases: a null text stays null and has no lines; an empty text has no line that counts; blank lines take no part and
always stay; a null id comes before every id; rows that share an id are ordered by a hash of their text; repeated rows
(id and text) are one document and give repeated results; an empty table gives an empty result; other columns are passed
on untouched: a column that is added under a name that one of them has takes underscores until it is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, added, cut, shuffle_partitions


def _counts(line: Column) -> Column:
    """Whether a line is not blank."""
    return line.rlike("[^ \t\r]")


def _own(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: the id, and a hash of the text for rows that share one."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text_col).alias("key")]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(number, doc, key, lines): documents numbered by id, their lines that count as hashes and lengths.  Written, so the numbers stay."""
    lines = F.filter(F.split(F.col(text_col), "\n"), _counts)
    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.char_length(x).alias("chars")))
    # repeated rows are one document
    each = docs.select(*_own(docs, id_col, text_col), ids.alias("lines")).where(F.size("lines") > 0).groupBy("doc", "key").agg(F.first("lines").alias("lines"))
    in_order = each.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc", "key").sortWithinPartitions("doc", "key")
    return cut(in_order.select(F.monotonically_increasing_id().alias("number"), "doc", "key", "lines"))


def _places(numbered: DataFrame) -> DataFrame:
    """(number, at, place, a, b, chars): a row for each line.  place: its number in the corpus, in the order of documents and lines."""
    lines = numbered.select("number", F.posexplode("lines").alias("at", "line"))
    return lines.select("number", "at", F.monotonically_increasing_id().alias("place"), "line.a", "line.b", "line.chars")


def _ranked(places: DataFrame, name: list[str]) -> DataFrame:
    """Places whose name another place has too, with the first of them as `rank`."""
    names = places.groupBy(*name).agg(F.min("place").alias("rank"), F.max("place").alias("last")).where("rank != last").drop("last")
    return places.join(cut(names), name)


def _least_runs(live: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(number, at, n): least runs among places that repeat.  live: (number, at, chars)."""
    doc = Window.partitionBy("number")
    by = doc.orderBy("at")
    whole = live.withColumn("upto", F.sum("chars").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.withColumn("before", F.col("upto") - F.col("chars"))
    # a run that can't lose its last line: lines while fewer than min_chars characters come before them
    short = max(min_chars, 1) - 1
    from_here = doc.orderBy("before").rangeBetween(0, short)
    to_here = doc.orderBy("upto").rangeBetween(-short, 0)
    more, less = by.rowsBetween(0, min_lines - 1), by.rowsBetween(1 - min_lines, 0)
    sized = whole.select(
        "number",
        "at",
        F.greatest(F.max("at").over(from_here), F.max("at").over(more)).alias("end"),
        F.greatest(F.count("*").over(from_here), F.count("*").over(more)).alias("n1"),
        F.greatest(F.max("upto").over(from_here), F.max("upto").over(more)).alias("end_chars"),
        F.least(F.min("at").over(to_here), F.min("at").over(less)).alias("begin"),
        F.greatest(F.count("*").over(to_here), F.count("*").over(less)).alias("n2"),
        F.least(F.min("before").over(to_here), F.min("before").over(less)).alias("begin_chars"),
        "upto",
        "before",
    )
    # none of its lines may be missing, and it must count
    first = F.when((F.col("end") - F.col("at") + 1 == F.col("n1")) & (F.col("n1") >= min_lines) & (F.col("end_chars") - F.col("before") >= min_chars), F.struct("at", F.col("n1").alias("n")))
    last = F.when((F.col("at") - F.col("begin") + 1 == F.col("n2")) & (F.col("n2") >= min_lines) & (F.col("upto") - F.col("begin_chars") >= min_chars), F.struct(F.col("begin").alias("at"), F.col("n2").alias("n")))
    runs = sized.select("number", F.explode(F.array_distinct(F.array_compact(F.array(first, last)))).alias("run"))
    return runs.select("number", "run.at", "run.n").distinct()


def copied_runs(numbered: DataFrame, min_lines: int = 1, min_chars: int = 50) -> DataFrame:
    """(number, at, n): least runs that occur at an earlier place; together they cover all copied runs that count."""
    min_lines = max(1, min_lines)
    live = cut(_ranked(_places(numbered), ["a", "b"]).drop("a", "b"))
    runs = cut(_least_runs(live, min_lines, min_chars).withColumn("level", F.floor(F.log2("n") + 1e-9).cast("int")))
    deepest = runs.agg(F.max("level")).first()[0]
    if deepest is None:
        return runs.select("number", "at", "n")
    ranks = live.drop("chars")
    levels = ranks.withColumn("level", F.lit(0))
    for k in range(deepest):
        further = Window.partitionBy("number").orderBy("at").rangeBetween(1 << k, 1 << k)
        pairs = ranks.withColumn("next", F.max("rank").over(further)).where("next IS NOT NULL").withColumnRenamed("rank", "here")
        ranks = cut(_ranked(pairs, ["here", "next"]).select(*ranks.columns))
        levels = levels.unionAll(ranks.withColumn("level", F.lit(k + 1)))
    # the two ranks that name a run
    begin = runs.join(levels, ["number", "at", "level"]).withColumnRenamed("rank", "here")
    power = F.expr("shiftleft(1, level)")
    whole = begin.where(F.col("n") == power).select("number", "at", "n", "place", F.col("here").alias("rank"))
    flush = levels.select("number", F.col("at").alias("at2"), "level", F.col("rank").alias("next"))
    named = begin.where(F.col("n") != power).withColumn("at2", (F.col("at") + F.col("n") - power).cast("int")).join(flush, ["number", "at2", "level"])
    longer = _ranked(named, ["n", "here", "next"]).select(*whole.columns)
    return whole.unionAll(longer).where("rank != place").select("number", "at", "n")


def repeated_runs(numbered: DataFrame, min_lines: int = 1, min_chars: int = 50) -> DataFrame:
    """(number, at, n): maximal stretches of lines that later copies of repeated runs cover."""
    doc = Window.partitionBy("number").orderBy("at")
    found = copied_runs(numbered, min_lines, min_chars).groupBy("number", "at").agg((F.col("at") + F.max("n")).alias("end"))
    reach = F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int"))
    runs = parted.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("number", "run").agg(F.min("at").alias("at"), F.max("end").alias("end")).select("number", "at", (F.col("end") - F.col("at")).alias("n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, min_chars: int = 50) -> DataFrame:
    """docs with text_col without the later copies of repeated line runs; n_lines, n_removed and emptied (no line that counts is left) are added."""
    numbered = _numbered(docs, id_col, text_col)
    each = repeated_runs(numbered, min_lines, min_chars).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("runs"))
    runs = each.join(numbered.select("number", "doc", "key"), "number").drop("number")
    rest = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in docs.columns if c.lower() != text_col.lower()])
    texts = docs.select(rest.alias("row"), F.col(text_col).alias("text"), *_own(docs, id_col, text_col))
    whole = texts.join(runs, ["doc", "key"], "left").withColumn("lines", F.when(F.col("runs").isNotNull(), F.split("text", "\n")))
    # the places, among all lines, of those that count; of these the ones that go; and what stays
    counting = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: _counts(F.get("lines", i)))
    whole = whole.withColumn("counting", F.when(F.col("lines").isNotNull(), counting))
    gone = F.flatten(F.transform("runs", lambda r: F.slice("counting", (r.at + 1).cast("int"), r.n.cast("int"))))
    whole = whole.withColumn("gone", F.when(F.col("lines").isNotNull(), gone))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    n_lines, n_removed, emptied = added(docs.columns, "n_lines", "n_removed", "emptied")
    # generated, so that a filter on what comes out does not work it out once more
    made = F.struct(text.alias("text"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("gone") == F.size("counting"), F.lit(False)).alias("emptied"))
    number = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = whole.select("row", number.alias("n_lines"), F.explode(F.array(made)).alias("made"))
    return out.select(
        *[F.col("made.text").alias(c) if c.lower() == text_col.lower() else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.col("n_lines").alias(n_lines),
        F.col("made.n_removed").alias(n_removed),
        F.col("made.emptied").alias(emptied),
    )
