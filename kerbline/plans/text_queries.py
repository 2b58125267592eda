"""Symbolic documents, rule vocabularies and mined text, run on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import classify, symbolic, text
from kerbline.functions.symbolic import Condition, Vocabulary
from kerbline.operators import vocabulary
from kerbline.registry import query, r6, table
from kerbline.session import spread

#: A small vocabulary of our own for the queries below; real ones are read from files (kerbline.sources.vocabularies).
VOCAB = Vocabulary(
    types={"Vehicle": "Vehicle", "Car": "Vehicle", "Truck": "Vehicle", "TrafficLight": "TrafficLight"},
    attributes={"Vehicle": {"lane": ("EgoLane", "LeftLane"), "motion": ("Stopped", "Moving")}, "TrafficLight": {"color": ("Red", "Green", "Off")}},
    facts={
        "LeadStopped": (Condition("entity", "Vehicle", equals={"lane": "EgoLane", "motion": "Stopped"}),),
        "RedLight": (Condition("entity", "TrafficLight", among={"color": ("Red",)}),),
        "NoLight": (Condition("no_entity", "TrafficLight"),),
        "EgoSlow": (Condition("ego", equals={"speed": "Slow"}), Condition("entity", "Vehicle", "Truck")),
        "CanStop": (Condition("judgment"),),
    },
    lateral=("KeepLane", "ChangeLeft"),
    longitudinal=("ConstantSpeed", "Stop", "Decelerate", "QuickDecelerate", "Accelerate"),
    same=(("Stop", "Decelerate", "QuickDecelerate"), ("Accelerate",)),
)

#: One document per customer; both engines build the same text.
_DOC = """'PERCEPTION:' || chr(10) || 'v_1 = ' || CASE WHEN c_custkey % 7 = 0 THEN 'Truck' ELSE 'Car' END || ' {lane: EgoLane, motion: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Stopped' ELSE 'Moving' END || '}' || chr(10)
|| CASE WHEN c_custkey % 3 = 0 THEN 'tl_1 = TrafficLight {color: ' || CASE WHEN c_custkey % 4 = 0 THEN 'Green' ELSE 'Red' END || '}' || chr(10) ELSE '' END
|| 'OPERATIONS:' || chr(10) || 'Query(v_1.motion) = Stopped' || chr(10) || 'Count(Vehicle) = 1' || chr(10) || 'EgoQuery(speed) = ' || CASE WHEN c_custkey % 11 = 0 THEN 'Fast' ELSE 'Slow' END || chr(10)
|| 'FACTS:' || chr(10) || 'LeadStopped = True' || chr(10) || 'RedLight = ' || CASE WHEN c_custkey % 5 < 3 THEN 'True' ELSE 'False' END || chr(10) || 'NoLight = True' || chr(10) || 'EgoSlow = True' || chr(10) || 'CanStop = True' || chr(10)
|| 'RULES:' || chr(10) || 'LeadStopped AND NOT RedLight -> KeepLane, Stop' || chr(10)
|| 'ACTION:' || chr(10) || 'KeepLane, ' || CASE WHEN c_custkey % 6 = 0 THEN 'Accelerate' WHEN c_custkey % 6 = 1 THEN 'Decelerate' ELSE 'Stop' END"""

_D = f"docs AS (SELECT c_custkey AS id, {_DOC} AS text FROM customer)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), F.expr(_DOC).alias("text"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("doc", symbolic.parse(F.col("text"), VOCAB))


@query(
    "sections_split",
    f"""WITH {_D} SELECT id, regexp_extract(text, '(?s)PERCEPTION:\\s*(.*?)\\s*OPERATIONS:', 1) AS perception, regexp_extract(text, '(?s)RULES:\\s*(.*?)\\s*ACTION:', 1) AS rules, regexp_extract(text, '(?s)ACTION:\\s*(.*)$', 1) AS action FROM docs""",
)
def sections_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbolic.sections(F.col("text"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return _docs(spark, sf_dir).select("id", strip(s["PERCEPTION"]).alias("perception"), strip(s["RULES"]).alias("rules"), strip(s["ACTION"]).alias("action"))


@query(
    "parse_entities",
    rf"""WITH {_D}, l AS (SELECT id, unnest(regexp_extract_all(text, '\w+ = \w+ \{{[^}}]*\}}')) AS line FROM docs)
SELECT id, regexp_extract(line, '^(\w+)', 1) AS entity, regexp_extract(line, '= (\w+)', 1) AS entity_type,
CASE regexp_extract(line, '= (\w+)', 1) WHEN 'Car' THEN 'Vehicle' WHEN 'Truck' THEN 'Vehicle' ELSE regexp_extract(line, '= (\w+)', 1) END AS base_type,
nullif(regexp_extract(line, 'motion: (\w+)', 1), '') AS motion, nullif(regexp_extract(line, 'color: (\w+)', 1), '') AS color FROM l""",
)
def parse_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _parsed(spark, sf_dir).select("id", F.explode("doc.entities").alias("e"))
    at = lambda k: F.try_element_at(F.col("e.attributes"), F.lit(k)).alias(k)
    return e.select("id", F.col("e.id").alias("entity"), "e.entity_type", "e.base_type", at("motion"), at("color"))


@query("parse_operations", f"WITH {_D} SELECT id, unnest(['Query', 'Count', 'EgoQuery']) AS op_type, unnest(['Query(v_1.motion)', 'Count(Vehicle)', 'EgoQuery(speed)']) AS expression, unnest(['Stopped', '1', CASE WHEN id % 11 = 0 THEN 'Fast' ELSE 'Slow' END]) AS result FROM docs")
def parse_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("id", F.explode("doc.operations").alias("o")).select("id", "o.op_type", "o.expression", "o.result")


@query("parse_facts", rf"WITH {_D}, l AS (SELECT id, unnest(regexp_extract_all(text, '\w+ = (?:True|False)')) AS line FROM docs) SELECT id, split_part(line, ' = ', 1) AS name, split_part(line, ' = ', 2) = 'True' AS value FROM l")
def parse_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("id", F.explode("doc.facts").alias("f")).select("id", "f.name", "f.value")


@query("parse_rules", f"WITH {_D} SELECT id, unnest(['LeadStopped', 'RedLight']) AS name, unnest([true, false]) AS expected, 'KeepLane' AS lateral, 'Stop' AS longitudinal FROM docs")
def parse_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = symbolic.rules(symbolic.sections(F.col("text"))["RULES"])
    # explode would have the documents parsed once more for each half of a filter on the array's size
    r = _docs(spark, sf_dir).select("id", F.explode_outer(rules).alias("r")).where("r IS NOT NULL")
    return r.select("id", F.explode("r.conditions").alias("c"), "r.lateral", "r.longitudinal").select("id", "c.name", "c.expected", "lateral", "longitudinal")


@query("parse_action", rf"WITH {_D} SELECT id, regexp_extract(text, '(?s)ACTION:\s*(\w+), (\w+)', 1) AS lateral, regexp_extract(text, '(?s)ACTION:\s*(\w+), (\w+)', 2) AS longitudinal FROM docs")
def parse_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("id", F.col("doc.selected_lateral").alias("lateral"), F.col("doc.selected_longitudinal").alias("longitudinal"))


@query("print_round_trip", f"WITH {_D} SELECT id, true AS same FROM docs")
def print_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = _parsed(spark, sf_dir).withColumn("again", symbolic.parse(symbolic.to_text(F.col("doc")), VOCAB))
    return again.select("id", (F.to_json("doc") == F.to_json("again")).alias("same"))


@query(
    "symbolic_violations",
    """SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_violations, c_custkey % 6 > 1 AS action_consistent FROM customer""",
)
def symbolic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    return _parsed(spark, sf_dir).select("id", F.size(symbolic.violations(doc, VOCAB)).cast("long").alias("n_violations"), symbolic.action_consistent(doc).alias("action_consistent"))


_GROUND = """g AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS lead_stopped, c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AS red_light, c_custkey % 3 <> 0 AS no_light, c_custkey % 11 <> 0 OR c_custkey % 7 = 0 AS ego_slow, c_custkey % 5 < 3 AS red_said FROM customer)"""


def _holds(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _parsed(spark, sf_dir).select("id", symbolic.fact_holds(F.col("doc"), VOCAB.facts[name]).alias("holds"))

    return run


for _key, _fact, _col in (("ground_exists", "LeadStopped", "lead_stopped"), ("ground_in", "RedLight", "red_light"), ("ground_not_exists", "NoLight", "no_light"), ("ground_any", "EgoSlow", "ego_slow")):
    query(_key, f"WITH {_GROUND} SELECT id, {_col} AS holds FROM g")(_holds(_fact))


@query(
    "grounding_score",
    f"""WITH {_GROUND} SELECT id, round((CAST(lead_stopped AS INT) + CAST(red_said AND red_light AS INT) + CAST(no_light AS INT) + CAST(ego_slow AS INT) + 1) / CAST(4 + CAST(red_said AS INT) AS DOUBLE), 6) AS score, CAST(1 AS BIGINT) AS n_judged FROM g""",
)
def grounding_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _parsed(spark, sf_dir).select("id", symbolic.grounding(F.col("doc"), VOCAB).alias("g"))
    return g.select("id", r6("g.grounding_score").alias("score"), F.size("g.judgment_facts").cast("long").alias("n_judged"))


@query("complexity", "SELECT c_custkey AS id, round(((1 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) / 6e0 + 3 / 8e0 + 5 / 10e0 + 2 / 6e0) / 4, 6) AS complexity, 1e0 AS completeness FROM customer")
def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "doc."
    conditions = F.aggregate(d + "rules", F.lit(0), lambda a, r: a + F.size(r.conditions))
    score = classify.complexity(F.size(d + "entities"), F.size(d + "operations"), F.size(d + "facts"), conditions, F.size(d + "errors") == 0)
    return _parsed(spark, sf_dir).select("id", r6(score).alias("complexity"), symbolic.stage_completeness(F.col("doc")).alias("completeness"))


@query("parse_rates", f"WITH {_GROUND} SELECT count(*) AS n, 1e0 AS parse_rate, round(avg(CASE WHEN id % 6 = 0 THEN 0e0 ELSE 1e0 END), 6) AS valid_rate FROM g")
def parse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    rate = lambda c: r6(F.count_if(c) / F.greatest(F.count("*"), F.lit(1)))
    return _parsed(spark, sf_dir).agg(F.count("*").alias("n"), rate(F.size("doc.errors") == 0).alias("parse_rate"), rate(F.size(symbolic.violations(doc, VOCAB)) == 0).alias("valid_rate"))


@query(
    "phrase_symbols",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'KeepLane' WHEN starts_with(lower(o_orderpriority), '1-') THEN 'ChangeLeft' ELSE 'KeepLane' END AS lateral,
CASE WHEN o_orderpriority = '5-LOW' THEN 'ConstantSpeed' WHEN contains(lower(o_orderpriority), 'urgent') THEN 'QuickDecelerate' WHEN contains(lower(o_orderpriority), 'high') THEN 'Decelerate' ELSE 'ConstantSpeed' END AS longitudinal FROM orders""",
)
def phrase_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = symbolic.phrase_to_symbols(F.col("o_orderpriority"), [("1-", "ChangeLeft")], [("urgent", "QuickDecelerate"), ("high", "Decelerate")])
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s.lateral", "s.longitudinal")


# ------------------------------------------------------------------ vocabularies as tables
_RULES = "VALUES ('R1', 90, 'LeadStopped'), ('R2', 88, 'RedLight'), ('R3', 88, 'Missing'), ('R3', 70, 'EgoSlow'), ('R4', 90, 'Gone')"
#: Customers as rules, some of one id; suppliers as listed facts, with repeats; nations beyond the facts are unknown.
_RULE_ROWS = "SELECT 'R' || c_custkey % 100 AS rule_id, c_custkey % 90 AS priority, 'F' || c_nationkey AS fact FROM customer"
_FACT_ROWS = "SELECT 'F' || s_suppkey % 7 AS name FROM supplier"


def _vocab_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("customer", "supplier"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(_RULE_ROWS), spark.sql(_FACT_ROWS)


@query(
    "rule_fk_checks",
    f"WITH r AS ({_RULE_ROWS}), f AS ({_FACT_ROWS}) SELECT 'rule fact' AS \"check\", rule_id || '.' || fact AS item FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE name = fact) UNION ALL SELECT 'fields', rule_id || '.category' FROM r",
)
def rule_fk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, facts = _vocab_tables(spark, sf_dir)
    lacking = vocabulary.missing_references(rules, ["fact"], facts, ["name"], "rule fact").select(F.col("item").alias("fact")).distinct()
    unknown = rules.join(lacking, "fact", "left_semi").select(F.lit("rule fact").alias("check"), F.concat_ws(".", "rule_id", "fact").alias("item"))
    fields = vocabulary.missing_fields(rules.withColumn("present", F.array(F.lit("rule_id"), F.lit("priority"))), "rule_id", "present", ["rule_id", "priority", "category"], "fields")
    return vocabulary.all_problems([unknown, fields])


@query(
    "rule_dupes",
    f"WITH r AS ({_RULE_ROWS}), f AS ({_FACT_ROWS}) SELECT 'rule id' AS \"check\", rule_id AS item FROM r GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'fact', name FROM f GROUP BY name HAVING count(*) > 1",
)
def rule_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, facts = _vocab_tables(spark, sf_dir)
    return vocabulary.all_problems([vocabulary.repeats(rules, ["rule_id"], "rule id"), vocabulary.repeats(facts, ["name"], "fact")])


@query(
    "rule_pick",
    f"WITH r(rule_id, priority, fact) AS ({_RULES}) SELECT o_custkey, rule_id, priority FROM orders JOIN r ON o_orderkey % 5 = length(fact) % 5 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY priority DESC, rule_id) = 1",
)
def rule_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {_RULES} AS r(rule_id, priority, fact)")
    fits = table(spark, sf_dir, "orders").join(rules, F.col("o_orderkey") % 5 == F.length("fact") % 5)
    return vocabulary.chosen_rule(fits, "o_custkey").select("o_custkey", "rule_id", "priority")


# ------------------------------------------------------------------ mined text
@query("qa_mining", "SELECT conv_id, turn, lower(split_part(text, '.', 1)) AS sentence, contains(lower(text), 'the') AS mentions FROM conversations")
def qa_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_sentence(F.col("text")).alias("sentence"), F.contains(F.lower("text"), F.lit("the")).alias("mentions"))


@query(
    "marked_replace",
    "SELECT c_custkey, 'see ' || CASE WHEN c_custkey % 2 = 0 THEN 'a red car' ELSE '<c' || c_custkey % 4 || '>' END || ' and a sign' AS said FROM customer",
)
def marked_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("see <c"), (F.col("c_custkey") % 4).cast("string"), F.lit("> and <s>"))
    names = F.create_map(*map(F.lit, ("c0", "a red car", "c2", "a red car", "s", "a sign")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.replace_marked(raw, names).alias("said"))


@query("md_token_parse", "SELECT event_id, 'log' || user_id AS base, CAST(event_id % 1000 AS INTEGER) AS number, 'log' || user_id || '-' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') AS token FROM events")
def md_token_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = text.frame_token(F.concat(F.lit("log"), F.col("user_id").cast("string")), F.col("event_id") % 1000)
    own = table(spark, sf_dir, "events").select("event_id", token.alias("token"))
    return own.select("event_id", text.token_base(F.col("token")).alias("base"), text.token_number(F.col("token")).alias("number"), "token")


@query("path_parts", "SELECT page_id, list_extract(string_split(url, '/'), -1) AS last, list_extract(string_split(url, '/'), -2) AS folder FROM pages")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.path_part(F.col("url"), -1).alias("last"), text.path_part(F.col("url"), -2).alias("folder"))


@query("action_tokens", "SELECT o_orderkey, '<action_' || o_custkey || '><action_' || o_orderkey % 7 || '>' AS text, CAST(o_custkey AS INTEGER) AS first_id, CAST(o_orderkey % 7 AS INTEGER) AS second_id FROM orders")
def action_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").select("o_orderkey", text.action_text(F.array("o_custkey", F.col("o_orderkey") % 7)).alias("text"))
    ids = text.action_ids(F.col("text"))
    return own.select("o_orderkey", "text", F.get(ids, F.lit(0)).alias("first_id"), F.get(ids, F.lit(1)).alias("second_id"))


@query(
    "token_masks",
    """WITH o AS (SELECT o_orderkey, [o_orderkey % 5, o_orderkey % 3, 2, o_orderkey % 4] AS ids FROM orders), p AS (SELECT *, coalesce(list_position(ids, 2), 0) AS mark, coalesce(list_position(ids, 3), 0) AS eos FROM o)
SELECT o_orderkey, CASE WHEN mark = 1 THEN ids[1] ELSE -100 END AS first_label, CASE WHEN mark > 0 AND mark <= 4 THEN ids[4] ELSE -100 END AS last_label, CAST(CASE WHEN eos = 0 THEN 4 ELSE eos END AS BIGINT) AS kept FROM p""",
)
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 3, F.lit(2).cast("long"), F.col("o_orderkey") % 4)
    own = table(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    labels, mask = classify.label_mask(F.col("ids"), F.lit(2).cast("long")), classify.completion_mask(F.col("ids"), F.lit(3).cast("long"))
    return own.select("o_orderkey", F.get(labels, F.lit(0)).alias("first_label"), F.get(labels, F.lit(3)).alias("last_label"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("kept"))


@query("state_sentence", "SELECT event_id, printf('The current speed is %.3f m/s and the acceleration is %.3f m/s^2.', value, event_id / 8e0) AS said FROM events")
def state_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.state_sentence(F.col("value"), F.col("event_id") / 8.0).alias("said"))
