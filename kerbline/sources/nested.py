"""Nested documents as variants: parsed once, walked by path, with the type of every value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that a walk goes down at most.
DEEPEST = 12


def parsed(rows: DataFrame, text: str, name: str = "doc") -> DataFrame:
    """rows with a variant of a JSON text; null where the text is null or is no JSON."""
    return rows.withColumn(name, F.try_parse_json(F.col(text)))


def walked(rows: DataFrame, key: str, doc: str = "doc", deepest: int = DEEPEST) -> DataFrame:
    """(key, path, type, value) of every value of every document, the document itself first (path `$`).

    Types are object, array, string, number, boolean and null; value is the text of a scalar, null for the others.  A
    level is one generator over what the level before left open; values below `deepest` levels are not walked.
    """
    kind = F.expr("schema_of_variant(_v)")
    plain = (
        F.when(F.expr("is_variant_null(_v)"), "null")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )
    front = rows.select(F.col(key).alias("_k"), F.lit("$").alias("path"), F.col(doc).alias("_v")).where("_v IS NOT NULL").withColumn("type", plain)
    out = None
    for depth in range(deepest + 1):
        scalar = F.when(F.col("type").isin("string", "number", "boolean"), F.expr("cast(_v as string)"))
        level = front.select(F.col("_k").alias(key), "path", "type", scalar.alias("value"))
        out = level if out is None else out.unionByName(level)
        if depth < deepest:
            fields = F.when(F.col("type") == "object", F.expr("cast(_v as map<string, variant>)"))
            items = F.when(F.col("type") == "array", F.expr("cast(_v as array<variant>)"))
            named = F.transform(F.map_entries(fields), lambda e: F.struct(F.concat(F.lit("."), e.key).alias("step"), e.value.alias("inner")))
            placed = F.transform(items, lambda v, i: F.struct(F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), v.alias("inner")))
            opened = front.where("type IN ('object', 'array')").select("_k", "path", F.explode(F.coalesce(named, placed)).alias("_e"))
            front = opened.select("_k", F.concat("path", "_e.step").alias("path"), F.col("_e.inner").alias("_v")).withColumn("type", plain)
    return out
