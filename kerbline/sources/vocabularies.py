"""Rule vocabularies from YAML files: a vocabulary is small and read on the driver; rules, of which there may be many files, are read by tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kerbline.functions.symbolic import Condition, Vocabulary
from kerbline.operators.rule_checks import RULE_DDL


def _load(text: str) -> dict:
    import yaml

    class Plain(yaml.SafeLoader):
        """Keeps words such as Off, On, Yes and No as text."""

    Plain.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return yaml.load(text, Loader=Plain) or {}  # noqa: S506  a safe loader


def _equals(condition: dict) -> dict:
    """What must be equal; a condition on the ego vehicle may name one attribute and its value."""
    own = {condition["attribute"]: condition.get("value", "")} if condition.get("attribute") else {}
    return own | (condition.get("equals") or {})


def vocabulary(entities: dict, facts: dict, actions: dict, same: tuple = ()) -> Vocabulary:
    """From parsed documents: entities {Base: {subtypes: [...], attributes: {name: [values]}}}, facts {Name: [conditions]},
    actions {lateral: [...], longitudinal: [...]}.  Repeated names keep the last."""
    types, attributes = {}, {}
    for base, body in entities.items():
        types[base] = base
        types |= dict.fromkeys(body.get("subtypes") or (), base)
        attributes[base] = {k: tuple(map(str, v)) for k, v in (body.get("attributes") or {}).items()}
    grounded = {
        name: tuple(
            Condition(c["kind"], c.get("type"), c.get("subtype"), {k: str(v) for k, v in _equals(c).items()}, {k: tuple(map(str, v)) for k, v in (c.get("in") or {}).items()})
            for c in conditions or ()
        )
        for name, conditions in facts.items()
    }
    return Vocabulary(types, attributes, grounded, tuple(actions.get("lateral", ())), tuple(actions.get("longitudinal", ())), same)


def read_vocabulary(path: str) -> Vocabulary:
    """From a folder with entities.yaml, facts.yaml and actions.yaml, or one file with the three as top keys."""
    p = Path(path)
    parts = {n: _load((p / f"{n}.yaml").read_text("utf-8")) for n in ("entities", "facts", "actions")} if p.is_dir() else _load(p.read_text("utf-8"))
    return vocabulary(parts.get("entities") or {}, parts.get("facts") or {}, parts.get("actions") or {})


def prompt_text(v: Vocabulary) -> str:
    """The vocabulary as plain lists, for a prompt."""
    lines = ["Types:"]
    lines += [f"- {t}" + (f" (a {b})" if t != b else "") for t, b in sorted(v.types.items())]
    lines += ["Attributes:"] + [f"- {b}.{a}: {', '.join(vals)}" for b, attrs in sorted(v.attributes.items()) for a, vals in sorted(attrs.items())]
    lines += ["Facts:"] + [f"- {f}" for f in sorted(v.facts)]
    return "\n".join([*lines, "Lateral actions: " + ", ".join(v.lateral), "Longitudinal actions: " + ", ".join(v.longitudinal)])


def _names(x) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else []


def _rule_row(rule: dict, source: str) -> dict:
    text = lambda k: None if rule.get(k) is None else str(rule[k])
    action = rule.get("action")
    return {
        "id": text("id"),
        "priority": json.dumps(rule["priority"], default=str) if "priority" in rule else None,
        "category": text("category"),
        "present": sorted(map(str, rule)),
        "preconditions": _names(rule.get("preconditions")),
        "action": {str(k): "" if v is None else str(v) for k, v in action.items()} if isinstance(action, dict) else {},
        "source": source,
    }


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A row a rule (RULE_DDL) of all files under path, each a list of rules or a mapping with the list at `rules`.

    A file is parsed whole by the task that reads it; entries that are no mapping, and empty files, give no row.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, text in zip(frame["source"], frame["value"], strict=True):
                body = _load(text)
                rules = body.get("rules") if isinstance(body, dict) else body
                rows = [_rule_row(r, source) for r in rules or () if isinstance(r, dict)]
                if rows:
                    yield pd.DataFrame(rows, dtype=object)

    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_name AS source", "value")
    return files.mapInPandas(parse, RULE_DDL)
