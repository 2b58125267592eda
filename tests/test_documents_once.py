"""Documents are searched for their headers once, whatever is taken from them, by as many tasks as there are cores."""

from __future__ import annotations

from kerbline.functions.symbolic import SECTIONS
from kerbline.queries import QUERIES


def test_rules_come_from_one_search_of_a_document(spark, sf_dir):
    found = QUERIES["parse_rules"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_instr(") == len(SECTIONS)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_printed_document_is_printed_once(spark, sf_dir):
    plan = QUERIES["print_round_trip"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\nPERCEPTION:\n") + plan.count("\nOPERATIONS:\n") <= 2  # the printer names either header once
    assert plan.count("regexp_instr(") == 2 * len(SECTIONS)
