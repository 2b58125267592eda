"""The same queries as SQL."""

from __future__ import annotations

from kerbline import queries  # noqa: F401
from kerbline.registry import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
