"""Rule vocabularies kept as tables: reference checks, repeats, rule choice.  Each check is an anti-join; the answers are rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_references(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], check: str) -> DataFrame:
    """(check, item): child rows whose keys the parent lacks."""
    p = parent.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(parent_keys)]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_p{i}")) for i, k in enumerate(keys)]
    return child.join(p, on, "left_anti").select(F.lit(check).alias("check"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]).alias("item"))


def repeats(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    """(check, item): keys that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1").select(F.lit(check).alias("check"), F.concat_ws(".", *[F.col(k).cast("string") for k in keys]).alias("item"))


def missing_fields(rows: DataFrame, key: str, present: str, required: Iterable[str], check: str) -> DataFrame:
    """(check, item): a row for each required field that an array of present fields lacks."""
    lacking = F.array_except(F.array(*map(F.lit, required)), F.col(present))
    return rows.select(F.lit(check).alias("check"), F.explode(lacking).alias("f"), key).select("check", F.concat_ws(".", key, "f").alias("item"))


def all_problems(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def chosen_rule(matching: DataFrame, by: str, priority: str = "priority", rule: str = "rule_id") -> DataFrame:
    """The matching rule with the highest priority, the first id on ties (an extension: the priorities are data that nothing else reads)."""
    w = Window.partitionBy(by).orderBy(F.desc(priority), rule)
    return matching.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def prompt_lines(values: DataFrame, base: str, attribute: str, value: str) -> DataFrame:
    """(line): each attribute of a base type with its values in order, as a prompt lists them.  values: a row a value, repeats allowed;
    rows without a base, attribute or value say nothing."""
    known = values.where(F.col(base).isNotNull() & F.col(attribute).isNotNull() & F.col(value).isNotNull()).select(base, attribute, value).distinct()
    listed = known.groupBy(base, attribute).agg(F.array_sort(F.collect_list(F.col(value).cast("string"))).alias("v"))
    return listed.select(F.concat(F.lit("- "), F.col(base), F.lit("."), F.col(attribute), F.lit(": "), F.array_join("v", ", ")).alias("line"))
