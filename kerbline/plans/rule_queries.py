"""Rule files written from the driver's tables, read back, and checked against vocabularies made of other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.rule_checks import RuleTables, rule_problems
from kerbline.registry import query, table
from kerbline.session import scratch
from kerbline.sources import vocabularies

#: Customers as rules; every seventh lacks its explanation, some have other faults.
_RULE = """SELECT CASE c_custkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'SM' ELSE 'XX' END || '-' || CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 3 ELSE c_custkey END AS id,
CAST(floor(c_acctbal / 45) AS BIGINT) AS priority, c_custkey % 17 = 0 AS quoted,
CASE WHEN c_custkey % 13 = 0 THEN 'comfort_meta' WHEN c_custkey % 3 = 0 THEN 'collision_avoidance' WHEN c_custkey % 3 = 1 THEN 'speed_management' ELSE 'other' END AS category,
'F' || c_custkey % 130 AS one, 'F' || c_nationkey AS other, 'L' || c_custkey % 4 AS sideways, 'D' || c_nationkey AS onward,
c_custkey % 19 = 0 AS more, c_custkey % 23 = 0 AS less, c_custkey % 7 <> 0 AS explained FROM customer"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as YAML lists, 2,000 rules a file at most, and read back."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    quote = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.concat(
        F.lit("- {id: "), F.col("id"), F.lit(", priority: "), F.when(F.col("quoted"), quote("priority")).otherwise(F.col("priority").cast("string")), F.lit(", category: "), F.col("category"),
        F.lit(", description: d, preconditions: ["), F.col("one"), F.lit(", NOT "), F.col("other"), F.lit("], action: {lateral: "), F.col("sideways"),
        F.when(F.col("less"), "").otherwise(F.concat(F.lit(", longitudinal: "), quote("onward"))), F.when(F.col("more"), ", speed: 'Off'").otherwise(""), F.lit("}"),
        F.when(F.col("explained"), ", explanation: e").otherwise(""), F.lit("}"),
    )
    path = scratch(spark, "rules")
    spark.sql(_RULE).select(line).write.option("maxRecordsPerFile", 2000).text(path)
    return vocabularies.read_rules(spark, path)


@query(
    "rule_files",
    f"SELECT id, CASE WHEN quoted THEN chr(34) || priority || chr(34) ELSE CAST(priority AS VARCHAR) END AS priority, category, one AS first_fact, sideways, CASE WHEN less THEN NULL ELSE onward END AS onward, 6 + CAST(explained AS INTEGER) AS n_fields, 'Off' AS speed FROM ({_RULE}) WHERE more UNION ALL SELECT id, CASE WHEN quoted THEN chr(34) || priority || chr(34) ELSE CAST(priority AS VARCHAR) END, category, one, sideways, CASE WHEN less THEN NULL ELSE onward END, 6 + CAST(explained AS INTEGER), NULL FROM ({_RULE}) WHERE NOT more",
)
def rule_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k, name: F.try_element_at("action", F.lit(k)).alias(name)
    return _rules(spark, sf_dir).select("id", "priority", "category", F.get("preconditions", F.lit(0)).alias("first_fact"), at("lateral", "sideways"), at("longitudinal", "onward"), F.size("present").alias("n_fields"), at("speed", "speed"))


#: Parts as conditions of facts, suppliers as listed facts (every fortieth twice), nations as entities, regions as actions.
_TABLES = {
    "cond": """SELECT 'F' || p_partkey % 60 AS fact, CAST(floor(p_partkey / 60) AS BIGINT) AS place, CASE p_partkey % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'no_entity' WHEN 2 THEN 'ego' WHEN 3 THEN 'judgment' ELSE 'other' END AS kind,
CASE WHEN p_partkey % 5 < 2 THEN 'B' || p_partkey % 27 END AS base_type, CASE WHEN p_partkey % 5 = 0 THEN 'S' || p_partkey % 4 END AS subtype, 'a' || p_partkey % 3 AS k, 'v' || p_partkey % 7 AS v, 'v' || p_partkey % 6 AS w,
'e' || p_partkey % 3 AS attribute, 'v' || p_partkey % 4 AS value FROM part""",
    "fact": "SELECT 'F' || s_suppkey AS fact FROM supplier UNION ALL SELECT 'F' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0",
    "entity": "SELECT 'B' || n_nationkey AS base_type FROM nation",
    "action": "SELECT 'lateral' AS part, 'L' || r_regionkey AS name FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'longitudinal', 'D' || n_nationkey FROM nation WHERE n_nationkey < 20",
}


@query(
    "rule_problems",
    "WITH rule AS (" + _RULE + "), " + ", ".join(f"{n} AS ({s})" for n, s in _TABLES.items()) + """, c AS (SELECT *, fact || '#' || place AS o, base_type IN (SELECT base_type FROM entity) AS known FROM cond)
SELECT DISTINCT * FROM (
SELECT 1 AS "check", id AS owner, one AS item FROM rule WHERE one NOT IN (SELECT fact FROM fact) UNION ALL SELECT 1, id, other FROM rule WHERE other NOT IN (SELECT fact FROM fact)
UNION ALL SELECT 2, id, sideways FROM rule WHERE sideways NOT IN (SELECT name FROM action WHERE part = 'lateral')
UNION ALL SELECT 3, id, CASE WHEN less THEN '' ELSE onward END FROM rule WHERE less OR onward NOT IN (SELECT name FROM action WHERE part = 'longitudinal')
UNION ALL SELECT 4, o, base_type FROM c WHERE NOT known
UNION ALL SELECT 5, o, base_type || '.' || subtype FROM c WHERE subtype IS NOT NULL AND (NOT known OR subtype = 'S3')
UNION ALL SELECT 6, o, base_type || '.a2' FROM c WHERE known AND k = 'a2'
UNION ALL SELECT 6, o, base_type || '.' || k || '.' || v FROM c WHERE known AND k <> 'a2' AND v IN ('v4', 'v5', 'v6')
UNION ALL SELECT 6, o, base_type || '.a0.' || w FROM c WHERE known AND w IN ('v4', 'v5')
UNION ALL SELECT 7, id, CAST(count(*) AS VARCHAR) FROM rule GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 8, id, CASE WHEN quoted THEN chr(34) || priority || chr(34) ELSE CAST(priority AS VARCHAR) END FROM rule WHERE quoted OR priority NOT BETWEEN 0 AND 200
UNION ALL SELECT 9, id, 'explanation' FROM rule WHERE NOT explained
UNION ALL SELECT 10, id, concat_ws(',', 'lateral', CASE WHEN NOT less THEN 'longitudinal' END, CASE WHEN more THEN 'speed' END) FROM rule WHERE less OR more
UNION ALL SELECT 11, fact, CAST(count(*) AS VARCHAR) FROM fact GROUP BY fact HAVING count(*) > 1
UNION ALL SELECT 12, fact, fact FROM fact WHERE fact NOT IN (SELECT fact FROM cond)
UNION ALL SELECT 13, o, kind FROM c WHERE kind = 'other'
UNION ALL SELECT 14, o, 'e2' FROM c WHERE kind = 'ego' AND attribute = 'e2'
UNION ALL SELECT 14, o, attribute || '.v3' FROM c WHERE kind = 'ego' AND attribute <> 'e2' AND value = 'v3'
UNION ALL SELECT 15, id, category FROM rule WHERE (id LIKE 'CA-%' AND category <> 'collision_avoidance') OR (id LIKE 'SM-%' AND category <> 'speed_management'))""",
)
def rule_problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen checks; nothing is said about files, as names of parts have no prefix."""
    for name in ("part", "supplier", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    made = {n: spark.sql(s) for n, s in _TABLES.items()}
    of_type = F.col("base_type").isNotNull()
    conditions = made["cond"].select(
        "fact", "place", "kind", "base_type", "subtype", F.when(of_type, F.create_map("k", "v")).alias("attributes"), F.when(of_type, F.create_map(F.lit("a0"), F.array(F.lit("v1"), "w"))).alias("attr_in"), "attribute", "value"
    )
    values = F.array(*[F.lit(f"v{i}") for i in range(4)])
    entities = made["entity"].select("base_type", F.array(*[F.lit(f"S{i}") for i in range(3)]).alias("subtypes"), F.create_map(F.lit("a0"), values, F.lit("a1"), values).alias("attributes"))
    ego = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.concat(F.lit("e"), F.col("r_regionkey").cast("string")).alias("attribute"), F.slice(values, 1, 3).alias("values"))
    return rule_problems(RuleTables(_rules(spark, sf_dir), conditions, conditions.select("fact").distinct(), made["fact"], entities, ego, made["action"]))
