"""Objects built from configuration: a mapping with `_target_` names a factory that was registered, the rest are its arguments."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from kerbline.plans import builders

FACTORIES: dict[str, Callable] = {"agent.constant_velocity": builders.constant_velocity, "agent.ground_truth": builders.ground_truth, "builder": builders.Builder}


def register(name: str) -> Callable:
    def add(f: Callable) -> Callable:
        FACTORIES[name] = f
        return f

    return add


def instantiate(config: Any) -> Any:
    """Only registered names can be built; nested mappings and lists are built first."""
    if isinstance(config, list):
        return [instantiate(x) for x in config]
    if not isinstance(config, dict):
        return config
    inner = {k: instantiate(v) for k, v in config.items() if k != "_target_"}
    if "_target_" not in config:
        return inner
    if config["_target_"] not in FACTORIES:
        raise ValueError(f"unknown target: {config['_target_']}")
    return FACTORIES[config["_target_"]](**inner)
