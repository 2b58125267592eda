"""The fifteen checks of a rule vocabulary that is kept as tables: every problem is a row (check, owner, item).

What refers to something is turned into chains of keys (base type, attribute, value); the distinct keys are anti-joined
with what is defined, and of each chain the first key that is missing is reported.  So a fact that a third of all rules
name is one row of that join.  The same problem named twice by an owner is one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of conditions, the fields of a rule and the categories that prefixes of ids stand for.
KINDS = ("entity", "no_entity", "ego", "judgment")
RULE_FIELDS = ("id", "priority", "category", "description", "preconditions", "action", "explanation")
ACTION_PARTS = ("lateral", "longitudinal")
CATEGORIES = {
    "TC": "traffic_control",
    "EM": "emergency",
    "PS": "pedestrian_safety",
    "CA": "collision_avoidance",
    "NV": "navigation",
    "SM": "speed_management",
    "CM": "comfort_meta",
}

RULE_DDL = "id string, priority string, category string, present array<string>, preconditions array<string>, action map<string,string>, source string"
CONDITION_DDL = "fact string, place long, kind string, base_type string, subtype string, attributes map<string,string>, attr_in map<string,array<string>>, attribute string, value string"


@dataclass(frozen=True)
class RuleTables:
    """rules: RULE_DDL, priority as JSON text; conditions: CONDITION_DDL; grounded: (fact); facts: (fact), as listed;
    entities: (base_type, subtypes array, attributes map of arrays); ego: (attribute, values array); actions: (part, name)."""

    rules: DataFrame
    conditions: DataFrame
    grounded: DataFrame
    facts: DataFrame
    entities: DataFrame
    ego: DataFrame
    actions: DataFrame


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _link(check: int, item: Column, kind: str, *key: Column) -> Column:
    """One key of a chain."""
    return F.struct(F.lit(check).alias("check"), item.alias("item"), F.array(F.lit(kind), *key).alias("key"))


def _chains(rows: DataFrame, owner: Column, chains: Column) -> DataFrame:
    return rows.select(owner.alias("owner"), F.explode(chains).alias("chain")).select("owner", F.col("chain").alias("links"))


def _rule_chains(rules: DataFrame) -> DataFrame:
    named = F.transform(F.coalesce("preconditions", F.array().cast("array<string>")), lambda p: F.trim(F.replace(_text(p), F.lit("NOT "), F.lit(""))))
    facts = F.transform(named, lambda f: F.array(_link(1, f, "fact", f)))
    done = [_text(F.try_element_at("action", F.lit(p))) for p in ACTION_PARTS]
    actions = F.array(*[F.array(_link(2 + i, a, "action", F.lit(p), a)) for i, (p, a) in enumerate(zip(ACTION_PARTS, done, strict=True))])
    return _chains(rules, F.coalesce("id", F.lit("?")), F.concat(facts, actions))


def _condition_chains(conditions: DataFrame) -> DataFrame:
    base, sub, attribute, value = _text("base_type"), _text("subtype"), _text("attribute"), _text("value")
    none = F.array().cast("array<array<struct<check:int,item:string,key:array<string>>>>")
    known = _link(4, base, "base", base)
    key = lambda k: _link(6, F.concat_ws(".", base, k), "attribute", base, k)
    held = lambda k, v: _link(6, F.concat_ws(".", base, k, v), "value", base, k, v)
    equal = F.transform(F.map_entries("attributes"), lambda e: F.array(known, key(e.key), held(e.key, _text(e.value))))
    among = F.flatten(
        F.transform(
            F.map_entries("attr_in"),
            lambda e: F.concat(F.array(F.array(known, key(e.key))), F.transform(F.coalesce(e.value, F.array().cast("array<string>")), lambda v: F.array(known, key(e.key), held(e.key, _text(v))))),
        )
    )
    of_type = F.concat(F.array(F.array(known)), F.coalesce(equal, none), F.coalesce(among, none))
    subtype = F.array(F.array(_link(5, F.concat_ws(".", base, sub), "subtype", base, sub)))
    ego = F.array(F.array(_link(14, attribute, "ego", attribute), _link(14, F.concat_ws(".", attribute, value), "ego", attribute, value)))
    chains = F.concat(F.when(base != "", of_type).otherwise(none), F.when((base != "") & (sub != ""), subtype).otherwise(none), F.when(F.col("kind") == "ego", ego).otherwise(none))
    return _chains(conditions, _place(), chains)


def _place() -> Column:
    return F.concat_ws("#", _text("fact"), F.col("place").cast("string"))


def _defined(t: RuleTables) -> DataFrame:
    """Every key that may be referred to."""
    attributes = t.entities.select("base_type", F.explode("attributes").alias("k", "vs"))
    found = [
        t.facts.select(F.array(F.lit("fact"), "fact").alias("key")),
        t.grounded.select(F.array(F.lit("grounded"), "fact").alias("key")),
        t.actions.select(F.array(F.lit("action"), "part", "name").alias("key")),
        t.entities.select(F.array(F.lit("base"), "base_type").alias("key")),
        t.entities.select("base_type", F.explode("subtypes").alias("s")).select(F.array(F.lit("subtype"), "base_type", "s").alias("key")),
        attributes.select(F.array(F.lit("attribute"), "base_type", "k").alias("key")),
        attributes.select("base_type", "k", F.explode("vs").alias("v")).select(F.array(F.lit("value"), "base_type", "k", "v").alias("key")),
        t.ego.select(F.array(F.lit("ego"), "attribute").alias("key")),
        t.ego.select("attribute", F.explode("values").alias("v")).select(F.array(F.lit("ego"), "attribute", "v").alias("key")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _unresolved(t: RuleTables) -> DataFrame:
    """Checks 1 to 6, 12 and 14: references that lead nowhere."""
    listed = _chains(t.facts, F.col("fact"), F.array(F.array(_link(12, F.col("fact"), "grounded", F.col("fact")))))
    chains = _rule_chains(t.rules).unionByName(_condition_chains(t.conditions)).unionByName(listed).distinct()
    links = chains.select("owner", "links", F.posexplode("links").alias("level", "link")).select("owner", "links", "level", "link.*")
    missing = links.select("key").distinct().join(_defined(t), "key", "left_anti")
    first = links.join(missing, "key").groupBy("owner", "links").agg(F.min_by(F.struct("check", "item"), "level").alias("p"))
    return first.select("p.check", "owner", "p.item").distinct()


def _malformed(t: RuleTables) -> DataFrame:
    """Checks 8 to 10, 13 and 15: what a row shows by itself."""
    owner, priority = F.coalesce("id", F.lit("?")), F.coalesce("priority", F.lit("null"))
    whole = priority.rlike("^-?[0-9]+$")
    problem = lambda check, wrong, item: F.when(wrong, F.array(F.struct(F.lit(check).alias("check"), item.cast("string").alias("item")))).otherwise(F.array().cast("array<struct<check:int,item:string>>"))
    lacking = F.array_except(F.array(*map(F.lit, RULE_FIELDS)), F.coalesce("present", F.array().cast("array<string>")))
    parts = F.array_sort(F.coalesce(F.map_keys("action"), F.array().cast("array<string>")))
    prefix = F.when(F.contains(_text("id"), F.lit("-")), F.substring_index("id", "-", 1)).otherwise("")
    from_file = F.when(F.contains(_text("source"), F.lit("_")), F.substring_index("source", "_", 1)).otherwise("")
    expected = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), prefix), F.lit(""))
    found = F.concat(
        problem(8, ~(whole & F.coalesce(priority.try_cast("decimal(38,0)").between(0, 200), F.lit(False))), priority),
        F.transform(lacking, lambda f: F.struct(F.lit(9).alias("check"), f.alias("item"))),
        problem(10, parts != F.array(*map(F.lit, sorted(ACTION_PARTS))), F.array_join(parts, ",")),
        problem(15, (expected != "") & (_text("category") != expected), _text("category")),
        problem(15, (from_file != "") & (prefix != "") & (from_file != prefix), F.col("source")),
    )
    rules = t.rules.select(owner.alias("owner"), F.explode(found).alias("p")).select("p.check", "owner", "p.item")
    kinds = t.conditions.where(~_text("kind").isin(*KINDS)).select(F.lit(13).alias("check"), _place().alias("owner"), _text("kind").alias("item"))
    return rules.unionByName(kinds).distinct()


def _repeated(rows: DataFrame, key: str, check: int) -> DataFrame:
    """Checks 7 and 11: how often a key is listed, where more than once."""
    again = rows.groupBy(_text(key).alias("owner")).count().where("count > 1")
    return again.select(F.lit(check).alias("check"), "owner", F.col("count").cast("string").alias("item"))


def rule_problems(t: RuleTables) -> DataFrame:
    """(check, owner, item).  The owner is a rule's id (`?` if it has none), a fact, or a fact and its condition's place.

    Absent maps and lists are empty, absent texts are ''; a priority must be a whole number from 0 to 200, neither quoted
    nor a truth value.  Empty tables have no problems, but what refers to them has.
    """
    return _unresolved(t).unionByName(_malformed(t)).unionByName(_repeated(t.rules, "id", 7)).unionByName(_repeated(t.facts, "fact", 11))
