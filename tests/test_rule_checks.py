"""Rule files and the fifteen checks, case by case."""

from __future__ import annotations

import pytest

from kerbline.operators.rule_checks import CONDITION_DDL, RULE_DDL, RuleTables, rule_problems
from kerbline.sources import vocabularies

GOOD = """rules:
  - id: CA-001
    priority: 83
    category: collision_avoidance
    description: >
      two
      lines
    preconditions: [PathBlocked, NOT EgoStopped]
    action: {lateral: KeepLane, longitudinal: Stop}
    explanation: because
"""


def _tables(spark, rules, conditions=None, facts=("PathBlocked", "EgoStopped")):
    conditions = [("PathBlocked", 0, "judgment", None, None, None, None, None, None)] if conditions is None else conditions
    c = spark.createDataFrame(conditions, CONDITION_DDL)
    return RuleTables(
        rules,
        c,
        spark.createDataFrame([(f,) for f in ("PathBlocked", "EgoStopped")], "fact string"),
        spark.createDataFrame([(f,) for f in facts], "fact string"),
        spark.createDataFrame([("Vehicle", ["Car"], {"motion": ["Stopped", "Moving"]}), ("Bare", None, None)], "base_type string, subtypes array<string>, attributes map<string,array<string>>"),
        spark.createDataFrame([("speed", ["Slow"])], "attribute string, values array<string>"),
        spark.createDataFrame([("lateral", "KeepLane"), ("longitudinal", "Stop")], "part string, name string"),
    )


def _found(tables):
    return sorted(tuple(r) for r in rule_problems(tables).collect())


def _read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.yaml").write_text(text, "utf-8")
    return vocabularies.read_rules(spark, str(tmp_path))


def test_a_sound_vocabulary_has_no_problem(spark, tmp_path):
    rules = _read(spark, tmp_path, CA_avoid=GOOD, empty="", SM_none="rules: []\n")
    assert rules.count() == 1 and rules.first().source == "CA_avoid.yaml"
    assert _found(_tables(spark, rules)) == []


def test_no_rules_and_no_conditions(spark):
    assert _found(_tables(spark, spark.createDataFrame([], RULE_DDL), [])) == []


@pytest.mark.parametrize(
    ("was", "now", "problem"),
    [
        ("PathBlocked, ", "Gone, ", (1, "CA-001", "Gone")),
        ("lateral: KeepLane", "lateral: Off", (2, "CA-001", "Off")),
        ("longitudinal: Stop", "longitudinal: Fly", (3, "CA-001", "Fly")),
        ("priority: 83", "priority: 201", (8, "CA-001", "201")),
        ("priority: 83", "priority: '83'", (8, "CA-001", '"83"')),
        ("priority: 83", "priority: 8.5", (8, "CA-001", "8.5")),
        ("    explanation: because\n", "", (9, "CA-001", "explanation")),
        ("Stop}", "Stop, speed: 3}", (10, "CA-001", "lateral,longitudinal,speed")),
        ("collision_avoidance", "navigation", (15, "CA-001", "navigation")),
    ],
)
def test_faults_of_rules(spark, tmp_path, was, now, problem):
    assert _found(_tables(spark, _read(spark, tmp_path, CA_avoid=GOOD.replace(was, now)))) == [problem]


def test_a_rule_of_nothing_and_a_wrong_file(spark, tmp_path):
    rules = _read(spark, tmp_path, SM_speed=GOOD, CA_b="- {}\n- text\n- id: CA-001\n  priority: 5\n  category: collision_avoidance\n  description: d\n  preconditions:\n  action: {lateral: KeepLane, longitudinal: Stop}\n  explanation: e\n")
    found = _found(_tables(spark, rules))
    assert (15, "CA-001", "SM_speed.yaml") in found and (7, "CA-001", "2") in found
    assert [p for p in found if p[1] == "?"] == [(2, "?", ""), (3, "?", ""), (8, "?", "null"), *[(9, "?", f) for f in sorted("id priority category description preconditions action explanation".split())], (10, "?", "")]


def test_faults_of_conditions_stop_at_the_first_unknown_name(spark, tmp_path):
    c = lambda i, kind, **k: ("PathBlocked", i, kind, *[k.get(n) for n in ("base_type", "subtype", "attributes", "attr_in", "attribute", "value")])
    conditions = [
        c(0, "entity", base_type="Nothing", attributes={"motion": "Stopped"}, attr_in={"x": ["y"]}),
        c(1, "entity", base_type="Vehicle", subtype="Bus", attributes={"motion": "Flying"}, attr_in={"motion": ["Stopped", "Gone"], "colour": ["Red"]}),
        c(2, "ego", attribute="height", value="Tall"),
        c(3, "ego", attribute="speed", value="Fast"),
        c(4, None),
        c(5, "no_entity", base_type="Bare", attributes={"any": None}, attr_in={"none": None}),
        c(6, "entity", base_type="Vehicle", subtype="Car", attributes={"motion": "Stopped"}),
        c(6, "entity", base_type="Vehicle", subtype="Car", attributes={"motion": "Stopped"}),
    ]
    found = _found(_tables(spark, _read(spark, tmp_path, CA_a=GOOD), conditions, ("PathBlocked", "EgoStopped", "EgoStopped", "Lonely")))
    assert found == [
        (4, "PathBlocked#0", "Nothing"),
        (5, "PathBlocked#1", "Vehicle.Bus"),
        (6, "PathBlocked#1", "Vehicle.colour"),
        (6, "PathBlocked#1", "Vehicle.motion.Flying"),
        (6, "PathBlocked#1", "Vehicle.motion.Gone"),
        (6, "PathBlocked#5", "Bare.any"),
        (6, "PathBlocked#5", "Bare.none"),
        (11, "EgoStopped", "2"),
        (12, "Lonely", "Lonely"),
        (13, "PathBlocked#4", ""),
        (14, "PathBlocked#2", "height"),
        (14, "PathBlocked#3", "speed.Fast"),
    ]


def test_prompt_lines_list_each_value_once(spark):
    from kerbline.operators.vocabulary import prompt_lines

    rows = [("Car", "motion", "b"), ("Car", "motion", "a"), ("Car", "motion", "b"), ("Car", None, "x"), (None, "motion", "x"), ("Car", "motion", None), ("Bus", "motion", "")]
    got = prompt_lines(spark.createDataFrame(rows, "base string, attribute string, value string"), "base", "attribute", "value")
    assert sorted(r.line for r in got.collect()) == ["- Bus.motion: ", "- Car.motion: a, b"]


def test_future_frames_leave_out_what_lies_beyond_the_end(spark):
    from kerbline.operators.sequence import future_frames

    rows = spark.createDataFrame([("a", i, None if i == 3 else 10 * i) for i in range(5)] + [("b", 0, 7)], "log string, idx long, token long")
    got = future_frames(rows, "token", "log", "idx", 0.3, 0.1, 2)
    assert sorted((r.log, r.idx, r.ahead, r.token or -1) for r in got.collect()) == [(log, i, k, -1 if i + k == 3 else 10 * (i + k)) for log in "a" for i in range(5) for k in (1, 2) if i + k < 5]
