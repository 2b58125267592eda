"""Walks over nested documents against a plain recursion."""

from __future__ import annotations

import json
import random

from kerbline.sources import nested


def plain(value, path="$"):
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "number"
    yield path, kind, None if kind in ("null", "object", "array") else str(value).lower() if kind == "boolean" else str(value)
    for step, inner in [(f".{k}", v) for k, v in value.items()] if kind == "object" else [(f"[{i}]", v) for i, v in enumerate(value)] if kind == "array" else []:
        yield from plain(inner, path + step)


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, False, 7, -3, "", "text", "é", 2**40])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b.c", "key", "value", "[0]"]) + str(i): made(rng, depth - 1) for i in range(rng.randrange(4))}


def test_every_value_by_its_path(spark):
    rng = random.Random(2)
    docs = [(k, made(rng, 5)) for k in range(60)]
    rows = [(k, json.dumps(d)) for k, d in docs] + [(100, None), (101, "{bad"), (102, "")]
    found = sorted((r["key"], r.path, r.type, str(r.value)) for r in nested.walked(nested.parsed(spark.createDataFrame(rows, "key int, text string"), "text"), "key", deepest=6).collect())
    assert found == sorted((k, p, t, str(v)) for k, d in docs for p, t, v in plain(d))
