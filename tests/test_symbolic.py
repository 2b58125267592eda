"""Symbolic documents: the cases of the format, one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kerbline.functions import classify, symbolic
from kerbline.functions.symbolic import Condition, Vocabulary
from kerbline.plans.text_queries import VOCAB

FULL = """PERCEPTION:
v_1 = Car {lane: EgoLane, motion: Stopped}
v_2 = Truck {lane: LeftLane, motion: Moving}
tl_1 = TrafficLight {color: Red}
OPERATIONS:
Query(v_1.motion) = Stopped
EgoQuery(speed) = Slow
Filter(Vehicle, lane = EgoLane) = {v_1}
FACTS:
LeadStopped = True
RedLight = True
CanStop = True
RULES:
LeadStopped AND RedLight → KeepLane, Stop
ACTION:
KeepLane, Stop
"""


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "text string").select(symbolic.parse(F.col("text"), VOCAB).alias("doc")).select(make(F.col("doc")).alias("x")).first().x


def doc(spark, text):
    return one(spark, text, lambda d: d)


def broken(spark, text):
    return one(spark, text, lambda d: symbolic.violations(d, VOCAB))


def test_full_document(spark):
    d = doc(spark, FULL)
    assert (len(d.entities), len(d.operations), len(d.facts), len(d.rules)) == (3, 3, 3, 1)
    assert list(d.errors) == [] and (d.selected_lateral, d.selected_longitudinal) == ("KeepLane", "Stop")
    assert d.entities[0].attributes == {"lane": "EgoLane", "motion": "Stopped"} and d.entities[1].base_type == "Vehicle"
    # a line splits at its first equals sign
    assert d.operations[2].expression == "Filter(Vehicle, lane" and d.operations[2].result == "EgoLane) = {v_1}"
    assert list(broken(spark, FULL)) == []
    g = one(spark, FULL, lambda d: symbolic.grounding(d, VOCAB))
    assert g.grounding_score == 1.0 and list(g.judgment_facts) == ["CanStop"]
    assert one(spark, FULL, symbolic.stage_completeness) == 1.0 and one(spark, FULL, symbolic.action_consistent)


def test_print_and_parse_again(spark):
    d = spark.createDataFrame([(FULL,)], "text string").select(symbolic.parse(F.col("text"), VOCAB).alias("doc"))
    again = d.select(F.to_json("doc").alias("a"), F.to_json(symbolic.parse(symbolic.to_text(F.col("doc")), VOCAB)).alias("b")).first()
    assert again.a == again.b


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (("v_1 = Car {lane: EgoLane, motion: Stopped}", "v_1 is a car"), "bad entity line"),
        (("v_1 = Car", "v_1 = Spaceship"), "unknown entity type"),
        (("lane: EgoLane", "EgoLane"), "bad attribute"),
        (("Query(v_1", "Ask(v_1"), "unknown operation"),
        (("LeadStopped = True", "LeadStopped = Perhaps"), "bad fact line"),
        (("→", "so"), "rule without arrow"),
        (("ACTION:\nKeepLane, Stop", "ACTION:\nKeepLane"), "bad action"),
    ],
)
def test_errors(spark, change, error):
    assert any(e.startswith(error) for e in doc(spark, FULL.replace(*change)).errors)


def test_no_headers_and_empty(spark):
    assert list(doc(spark, "nothing here").errors) == ["no section headers"]
    assert list(doc(spark, "").errors) == ["no section headers"]
    assert len(doc(spark, None).entities) == 0


def test_headers_in_any_case_and_order(spark):
    d = doc(spark, "action: KeepLane, Stop\nFacts:\nRedLight = False")
    assert d.selected_longitudinal == "Stop" and d.facts[0].value is False and list(d.errors) == []


@pytest.mark.parametrize(
    ("change", "violation"),
    [
        (("v_2 = Truck", "v_1 = Truck"), "duplicate entity: v_1"),
        (("color: Red", "color: Blue"), "bad attribute: tl_1.color=Blue"),
        (("Query(v_1.motion)", "Query(v_9.motion)"), "unknown queried entity: v_9"),
        (("RedLight = True", "LeadStopped = True"), "duplicate fact: LeadStopped"),
        (("CanStop = True", "Flying = True"), "unknown fact: Flying"),
        (("AND RedLight", "AND NoLight"), "rule on unlisted fact: NoLight"),
        (("KeepLane, Stop\nACTION", "Hover, Stop\nACTION"), "unknown lateral action: Hover"),
        (("ACTION:\nKeepLane, Stop", "ACTION:\nKeepLane, Accelerate"), "action of no rule"),
    ],
)
def test_violations(spark, change, violation):
    assert violation in broken(spark, FULL.replace(*change))


def test_absent_fact_may_be_negated_and_decelerations_are_equal(spark):
    assert list(broken(spark, FULL.replace("AND RedLight", "AND NOT NoLight"))) == []
    eased = FULL.replace("ACTION:\nKeepLane, Stop", "ACTION:\nKeepLane, Decelerate")
    assert list(broken(spark, eased)) == [] and not one(spark, eased, symbolic.action_consistent)


def test_colour_off_is_a_word(spark):
    assert list(broken(spark, FULL.replace("color: Red", "color: Off"))) == []


def test_repeated_attribute_keeps_the_last(spark):
    assert doc(spark, FULL.replace("lane: EgoLane,", "lane: LeftLane, lane: EgoLane,")).entities[0].attributes["lane"] == "EgoLane"


@pytest.mark.parametrize(
    ("condition", "holds"),
    [
        (Condition("entity", "Vehicle"), True),
        (Condition("entity", "Vehicle", "Truck"), True),
        (Condition("entity", "Vehicle", "Truck", {"lane": "EgoLane"}), False),
        (Condition("entity", "Vehicle", among={"motion": ("Moving", "Gone")}), True),
        (Condition("no_entity", "TrafficLight"), False),
        (Condition("no_entity", "Vehicle", equals={"lane": "Nowhere"}), True),
        (Condition("ego", equals={"speed": "Slow"}), True),
        (Condition("ego", equals={"speed": "Fast"}), False),
        (Condition("ego", equals={"heading": "Slow"}), False),
        (Condition("judgment"), True),
    ],
)
def test_conditions(spark, condition, holds):
    assert one(spark, FULL, lambda d: symbolic.condition_holds(d, condition)) is holds


def test_grounding_score_of_ungrounded_and_of_nothing(spark):
    g = one(spark, FULL.replace("color: Red", "color: Green"), lambda d: symbolic.grounding(d, VOCAB))
    assert g.grounding_score == pytest.approx(2 / 3) and list(g.ungrounded_facts) == ["RedLight"]
    none = FULL.replace("LeadStopped = True", "LeadStopped = False").replace("RedLight = True", "RedLight = False")
    assert one(spark, none, lambda d: symbolic.grounding(d, VOCAB)).grounding_score == 1.0
    assert one(spark, "FACTS:\nRedLight = True\nACTION:\nKeepLane, Stop", symbolic.stage_completeness) == 0.25


def test_ego_conditions_read_operations_only(spark):
    said = "{}OPERATIONS:\n{}\nFACTS:\nEgoSlow = True\nACTION:\nKeepLane, Stop"
    ground = lambda perception, ops: one(spark, said.format(perception, ops), lambda d: symbolic.grounding(d, VOCAB))
    assert ground("", "EgoQuery(speed) = Slow").grounding_score == 1.0
    # an entity that is called like the ego vehicle says nothing about it
    assert list(ground("PERCEPTION:\nego = Car {speed: Slow}\n", "Count(Vehicle) = 1").ungrounded_facts) == ["EgoSlow"]
    # of several answers the last one holds; another operation on the ego vehicle's speed is none
    assert ground("", "EgoQuery(speed) = Slow\nEgoQuery(speed) = Fast").grounding_score == 0.0
    assert ground("", "EgoQuery(speed) = Fast\nEgoQuery(speed) = Slow").grounding_score == 1.0
    assert ground("", "Query(speed) = Slow").grounding_score == 0.0


def test_judgment_counts_and_unknown_facts_do_not(spark):
    text = "FACTS:\nCanStop = True\nRedLight = True\nNobodyKnows = True\nACTION:\nKeepLane, Stop"
    g = one(spark, text, lambda d: symbolic.grounding(d, VOCAB))
    assert (g.grounding_score, list(g.ungrounded_facts), list(g.judgment_facts)) == (0.5, ["RedLight"], ["CanStop"])


def test_complexity_caps_and_unparseable(spark):
    f = lambda *n: spark.range(1).select(classify.complexity(*[F.lit(x) for x in n[:4]], F.lit(n[4]))).first()[0]
    assert f(6, 8, 10, 6, True) == 1.0 and f(60, 80, 100, 60, True) == 1.0 and f(3, 4, 5, 3, True) == 0.5 and f(0, 0, 0, 0, False) == 1.0


def test_vocabulary_file_keeps_off_as_text(tmp_path):
    from kerbline.sources.vocabularies import prompt_text, read_vocabulary

    (tmp_path / "v.yaml").write_text(
        "entities:\n  Light:\n    attributes:\n      color: [Red, Off, On]\nfacts:\n  Dark:\n    - {kind: entity, type: Light, equals: {color: Off}}\n  Slow:\n    - {kind: ego, attribute: speed, value: Low}\nactions:\n  lateral: [KeepLane]\n  longitudinal: [Stop]\n"
    )
    v = read_vocabulary(str(tmp_path / "v.yaml"))
    assert v.attributes["Light"]["color"] == ("Red", "Off", "On") and v.facts["Dark"][0].equals == {"color": "Off"}
    assert v.facts["Slow"] == (Condition("ego", equals={"speed": "Low"}),)
    assert isinstance(v, Vocabulary) and "Light.color: Red, Off, On" in prompt_text(v)
