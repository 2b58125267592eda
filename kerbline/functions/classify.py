"""Manoeuvre, state and outcome classes as ordered CASE expressions, and scalar scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def longitudinal_action(first_speed: Column, last_speed: Column, stop_eps: float = 0.3, constant_eps: float = 0.8, quick: float = 2.0) -> Column:
    """stop, speed kept, or (quick) acceleration / deceleration, from the speeds at both ends."""
    change = last_speed - first_speed
    return _first(
        [
            ((first_speed < stop_eps) & (last_speed < stop_eps), "stop"),
            (last_speed < stop_eps, "decelerate to stop"),
            (F.abs(change) < constant_eps, "keep speed"),
            ((change > 0) & (last_speed > quick * first_speed), "quick acceleration"),
            (change > 0, "acceleration"),
            (first_speed > quick * last_speed, "quick deceleration"),
        ],
        "deceleration",
    )


def lateral_action(last_y: Column, widest_y: Column, lane: float = 2.0, turn: float = 4.0) -> Column:
    """straight, lane change or turn by the widest lateral offset; left is positive."""
    side = F.when(last_y > 0, "left").otherwise("right")
    return F.when(widest_y < lane, "go straight").when(widest_y < turn, F.concat(F.lit("change lane to "), side)).otherwise(F.concat(F.lit("turn "), side))


def lateral_action_by_x(last_x: Column, eps: float = 0.5, turn: float = 4.0) -> Column:
    """The same for a frame whose x axis points right: left is negative."""
    side = F.when(last_x < 0, "left").otherwise("right")
    return F.when(F.abs(last_x) < eps, "go straight").when(F.abs(last_x) < turn, F.concat(F.lit("change lane to "), side)).otherwise(F.concat(F.lit("turn "), side))


def command_from_offset(x: Column, limit: float = 2.0) -> Column:
    return F.when(x >= limit, "right").when(x <= -limit, "left").otherwise("straight")


def speed_class(speed: Column) -> Column:
    return F.when(speed < 0.3, "stopped").when(speed < 3, "slow").when(speed < 8, "moderate").otherwise("fast")


def acceleration_class(a: Column) -> Column:
    return F.when(a > 0.5, "accelerating").when(a < -0.5, "decelerating").otherwise("constant")


def route_class(instruction: Column) -> Column:
    low = F.lower(instruction)
    return F.when(F.contains(low, F.lit("left")), "left").when(F.contains(low, F.lit("right")), "right").otherwise("straight")


def decode_command(one_hot: Column) -> Column:
    """The named direction of a one-hot vector of four."""
    return F.element_at(F.array(*map(F.lit, ("LEFT", "FORWARD", "RIGHT", "UNKNOWN"))), F.array_position(one_hot, F.array_max(one_hot)).cast("int"))


def collision_class(ego_speed: Column, track_speed: Column, behind: Column, front_hit: Column, stopped: float = 0.05) -> Column:
    """First match of: stopped ego, stopped track, rear, front, lateral."""
    return _first([(ego_speed <= stopped, "stopped_ego"), (track_speed <= stopped, "stopped_track"), (behind, "active_rear"), (front_hit, "active_front")], "active_lateral")


def direction_score(against: Column, good: float = 2.0, bad: float = 6.0) -> Column:
    return F.when(against < good, 1.0).when(against < bad, 0.5).otherwise(0.0)


def equivalence_class(action: Column) -> Column:
    """Longitudinal actions that count as the same."""
    return F.when(action.isin("Decelerate", "QuickDecelerate", "Stop"), "slower").when(action.isin("Accelerate", "QuickAccelerate"), "faster").otherwise(action)


def complexity(entities: Column, operations: Column, facts: Column, conditions: Column, parsed: Column) -> Column:
    """A quarter of four counts, each over its cap; 1 for what can't be parsed."""
    parts = [F.least(n / F.lit(float(cap)), F.lit(1.0)) for n, cap in ((entities, 6), (operations, 8), (facts, 10), (conditions, 6))]
    return F.when(parsed, (parts[0] + parts[1] + parts[2] + parts[3]) / 4).otherwise(1.0)


def length_penalty(text: Column, n_tokens: Column, marker: str = "complex scenario", middle: float = 400, slope: float = 0.002) -> Column:
    return F.when(F.contains(F.lower(text), F.lit(marker)), 1 / (1 + F.exp(-(n_tokens - middle) * slope))).otherwise(0.0)


def target_speed(fraction: Column, limit: Column, fallback: float = 15.0) -> Column:
    return fraction * F.coalesce(limit, F.lit(fallback))


def lead_velocity(speed: Column, heading: Column, ego_heading: Column, static: Column) -> Column:
    return F.when(static, 0.0).otherwise(speed * F.cos(heading - ego_heading))


def label_mask(ids: Column, marker: Column, ignore: int = -100) -> Column:
    """Ids before the first marker become `ignore` (all of them, if there is none)."""
    at = F.array_position(ids, marker)
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i + 1 >= at), x).otherwise(F.lit(ignore)))


def completion_mask(ids: Column, eos: Column) -> Column:
    """1 up to and with the first end id, all 1 if there is none."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))
