"""All queries of the engine, by name."""

from __future__ import annotations

from kerbline.plans import filter_queries, model_queries, planning_queries, rule_queries, scene_queries, score_queries, source_queries, stream_queries, text_queries  # noqa: F401
from kerbline.registry import QUERIES

__all__ = ["QUERIES"]
