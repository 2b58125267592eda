"""Simulation of proposals: car following, path tracking, a kinematic bicycle, and smoothing.

These are recurrences over a handful of steps, so each runs as one grouped function over the rows of its
proposal; the groups are small (tens of rows) and independent.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------------ smoothing (Savitzky-Golay)


def savgol_matrix(n: int, window: int, order: int, derivative: int = 0, dt: float = 1.0) -> np.ndarray:
    """Matrix that takes n samples to their smoothed values or derivatives; at the ends the first and last fits are used.

    A window as long as the series is one global fit.  An even window evaluates its fit half a step off its
    middle, at the sample.
    """
    window = min(window, n)
    order = min(order, window - 1)
    out = np.zeros((n, n))
    for i in range(n):
        start = min(max(i - window // 2, 0), n - window)
        t = np.arange(window) - (i - start)
        fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
        out[i, start : start + window] = fit[derivative] * math.factorial(derivative) / dt**derivative if derivative <= order else 0.0
    return out


def smooth(series: np.ndarray, window: int, order: int, derivative: int = 0, dt: float = 1.0) -> np.ndarray:
    return savgol_matrix(len(series), window, order, derivative, dt) @ series


def savgol(rows: DataFrame, by: str, order_by: str, value: str, window: int, order: int, derivative: int = 0, dt: float = 1.0) -> DataFrame:
    """(by, order_by, value, smoothed) for every row: weights of the row's place in its window, worked out beforehand for
    each place and for series shorter than a window, times the values around it."""
    w = Window.partitionBy(by).orderBy(order_by)
    matrices = [savgol_matrix(n, window, order, derivative, dt) for n in range(1, window + 1)]
    weights = F.array(*[F.array(*[F.array(*map(F.lit, map(float, line))) for line in m]) for m in matrices])
    own = rows.select(
        by,
        order_by,
        value,
        F.collect_list(F.col(value).cast("double")).over(w.rowsBetween(1 - window, window - 1)).alias("_near"),
        (F.row_number().over(w) - 1).alias("_i"),
        F.count("*").over(Window.partitionBy(by)).alias("_n"),
    )
    wide = F.least("_n", F.lit(window)).cast("int")
    start = F.least(F.greatest(F.col("_i") - window // 2, F.lit(0)), F.col("_n") - wide).cast("int")
    first = F.greatest(F.col("_i") - (window - 1), F.lit(0))
    line = F.get(F.get(weights, wide - 1), F.col("_i") - start)
    values = F.slice("_near", (start - first + 1).cast("int"), wide)
    return own.select(by, order_by, value, F.aggregate(F.zip_with(values, line, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("smoothed"))


# ------------------------------------------------------------------ car following
IDM = {"headway": 1.5, "gap_min": 1.0, "accel": 1.5, "decel": 3.0, "exponent": 10.0}


def idm_acceleration(v: np.ndarray, target: np.ndarray, gap: np.ndarray, lead_v: np.ndarray, p: dict = IDM) -> np.ndarray:
    """Acceleration towards the target speed behind a lead vehicle, clipped to what is comfortable."""
    wish = p["gap_min"] + v * p["headway"] + v * (v - lead_v) / (2 * math.sqrt(p["accel"] * p["decel"]))
    a = p["accel"] * (1 - (v / np.maximum(target, 1e-3)) ** p["exponent"] - (np.maximum(wish, 0) / np.maximum(gap, p["gap_min"])) ** 2)
    return np.clip(a, -p["decel"], p["accel"])


def idm(v: Column, target: Column, gap: Column, lead_v: Column, p: dict = IDM) -> Column:
    """The same as a column."""
    wish = p["gap_min"] + v * p["headway"] + v * (v - lead_v) / (2 * math.sqrt(p["accel"] * p["decel"]))
    a = p["accel"] * (1 - F.pow(v / F.greatest(target, F.lit(1e-3)), F.lit(p["exponent"])) - F.pow(F.greatest(wish, F.lit(0.0)) / F.greatest(gap, F.lit(p["gap_min"])), F.lit(2.0)))
    return F.least(F.greatest(a, F.lit(-p["decel"])), F.lit(p["accel"]))


def idm_rollout(v: float, target: float, lead_gap: float, lead_v: float, steps: int, dt: float) -> np.ndarray:
    """(progress, speed) after each step; the lead keeps its speed, speeds don't go below zero."""
    s, gap, out = 0.0, lead_gap, []
    for _ in range(steps):
        a = float(idm_acceleration(np.array([v]), np.array([target]), np.array([gap]), np.array([lead_v]))[0])
        new = max(v + a * dt, 0.0)
        s += v * dt
        gap += (lead_v - v) * dt
        v = new
        out.append((s, v))
    return np.array(out)


FRACTIONS, LATERALS = (0.2, 0.4, 0.6, 0.8, 1.0), (-1.0, 0.0, 1.0)
FREE_SPEED = 15.0


def idm_paths(speed: np.ndarray, target: np.ndarray, gap: np.ndarray, lead: np.ndarray, steps: int, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """(progress, speed) after each step, rows by steps: all rows abreast; leads keep their speeds, speeds don't go below zero."""
    v, s, gap = speed.astype(float), np.zeros(len(speed)), gap.astype(float)
    out_s, out_v = np.empty((len(v), steps)), np.empty((len(v), steps))
    for t in range(steps):
        a = idm_acceleration(v, target, gap, lead)
        s, gap, v = s + v * dt, gap + (lead - v) * dt, np.maximum(v + a * dt, 0.0)
        out_s[:, t], out_v[:, t] = s, v
    return out_s, out_v


def unroll_proposals(starts: DataFrame, fractions: tuple[float, ...] = FRACTIONS, laterals: tuple[float, ...] = LATERALS, steps: int = 40, dt: float = 0.1, only: str | None = None) -> DataFrame:
    """starts: (token, speed, limit, lead_gap, lead_speed).  One proposal per lateral offset and target fraction, each
    with its own lead state: (token, proposal, t, s, offset, speed).  only: a column with the one proposal that is wanted of a start."""
    grid = [(lat, f) for lat in laterals for f in fractions]
    whole = np.arange(len(grid), dtype=np.int32)
    fraction, lateral = np.array([f for _, f in grid]), np.array([lat for lat, _ in grid])

    def run(batches):
        for pdf in batches:
            n, m = len(pdf), 1 if only else len(grid)
            of = pdf[only].to_numpy(np.int32) if only else np.tile(whole, n)
            each = lambda c: np.repeat(pdf[c].to_numpy(float), m)
            limit = np.repeat(pdf.limit.fillna(FREE_SPEED).to_numpy(float), m)
            s, v = idm_paths(each("speed"), limit * fraction[of], each("lead_gap"), each("lead_speed"), steps, dt)
            yield pd.DataFrame(
                {
                    "token": np.repeat(pdf.token.to_numpy(), m * steps),
                    "proposal": np.repeat(of, steps),
                    "t": np.tile(np.arange(1, steps + 1, dtype=np.int32), n * m),
                    "s": s.ravel(),
                    "offset": np.repeat(lateral[of], steps),
                    "speed": v.ravel(),
                }
            )

    kind = dict(starts.dtypes)["token"]
    return starts.select("token", "speed", "limit", "lead_gap", "lead_speed", *([only] if only else [])).mapInPandas(run, f"token {kind}, proposal int, t int, s double, offset double, speed double")


# ------------------------------------------------------------------ vehicle model and tracker
WHEELBASE, STEER_MAX, ACCEL_TAU, STEER_TAU = 3.089, math.pi / 3, 0.2, 0.05


def bicycle_step(state: np.ndarray, accel_cmd: np.ndarray, steer_rate_cmd: np.ndarray, dt: float) -> np.ndarray:
    """states (n, 6): x, y, heading, speed, acceleration, steering.  Commands pass a first-order lag; then an Euler step."""
    x, y, h, v, a, steer = state.T
    a_new = a + dt / (dt + ACCEL_TAU) * (accel_cmd - a)
    wanted = steer + steer_rate_cmd * dt
    steer_new = np.clip(steer + dt / (dt + STEER_TAU) * (wanted - steer), -STEER_MAX, STEER_MAX)
    h_new = h + v * np.tan(steer) / WHEELBASE * dt
    return np.stack([x + v * np.cos(h) * dt, y + v * np.sin(h) * dt, np.arctan2(np.sin(h_new), np.cos(h_new)), v + a * dt, a_new, steer_new], axis=1)


def bicycle(x: Column, y: Column, h: Column, v: Column, a: Column, steer: Column, accel_cmd: Column, steer_rate_cmd: Column, dt: float) -> dict[str, Column]:
    """The same step as columns."""
    h_new = h + v * F.tan(steer) / WHEELBASE * dt
    turned = steer + dt / (dt + STEER_TAU) * (steer_rate_cmd * dt)
    return {
        "x": x + v * F.cos(h) * dt,
        "y": y + v * F.sin(h) * dt,
        "heading": F.atan2(F.sin(h_new), F.cos(h_new)),
        "speed": v + a * dt,
        "acceleration": a + dt / (dt + ACCEL_TAU) * (accel_cmd - a),
        "steering": F.least(F.greatest(turned, F.lit(-STEER_MAX)), F.lit(STEER_MAX)),
    }


def lqr_commands(state: np.ndarray, reference: np.ndarray, dt: float, horizon: int = 10, stop_speed: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """(acceleration, steering rate) for states (n, 6) that follow references (n, horizon + 1, 4): x, y, heading, speed.

    Speed: least squares towards the reference over the horizon.  Steering: least squares on lateral offset and
    heading with the motion linearised at the current speed.  Below stop_speed a proportional brake.
    """
    v, a, steer = state[:, 3], state[:, 4], state[:, 5]
    k = np.arange(1, reference.shape[1])
    steps = np.minimum(k, horizon) * dt
    want = reference[:, 1:, 3] - v[:, None]
    accel = (want * steps).sum(axis=1) / ((steps**2).sum() + 1.0 * dt)
    dx, dy = state[:, 0] - reference[:, 0, 0], state[:, 1] - reference[:, 0, 1]
    h_ref = reference[:, 0, 2]
    lateral = -dx * np.sin(h_ref) + dy * np.cos(h_ref)
    heading = np.arctan2(np.sin(state[:, 2] - h_ref), np.cos(state[:, 2] - h_ref))
    turn = np.diff(np.unwrap(reference[:, :, 2], axis=1), axis=1)
    curvature = turn.sum(axis=1) / np.maximum(np.abs(reference[:, 1:, 3]).sum(axis=1) * dt, 1e-3)
    t, speed, angle = np.arange(1, horizon + 1) * dt, v[:, None], heading[:, None]
    # heading and offset after t with a constant steering rate u, without and per unit of u
    free_h = angle + speed / WHEELBASE * (steer - np.arctan(curvature * WHEELBASE))[:, None] * t
    gain_h = speed / WHEELBASE * t**2 / 2
    free_e = lateral[:, None] + speed * (angle * t + (free_h - angle) * t / 2)
    gain_e = speed * speed / WHEELBASE * t**3 / 6
    rate = -(gain_h * (10 * free_h) + gain_e * free_e).sum(axis=1) / ((gain_h * (10 * gain_h) + gain_e * gain_e).sum(axis=1) + 1.0)
    stopped = (np.abs(v) <= stop_speed) & (np.abs(reference[:, -1, 3]) <= stop_speed)
    return np.where(stopped, -0.5 * v, accel), np.where(stopped, 0.0, rate)


def simulate_states(reference: np.ndarray, dt: float, horizon: int = 10) -> np.ndarray:
    """references (n, steps, 4) -> states (n, steps, 6): track, then propagate, step by step."""
    n, steps, _ = reference.shape
    state = np.zeros((n, 6))
    state[:, :4] = reference[:, 0]
    out = [state]
    for t in range(steps - 1):
        ahead = reference[:, np.minimum(np.arange(t, t + horizon + 1), steps - 1)]
        state = bicycle_step(state, *lqr_commands(state, ahead, dt, horizon), dt)
        out.append(state)
    return np.stack(out, axis=1)


#: Columns of a state, and steps that are worked on abreast at most, so that a task's memory does not follow the batch.
STATE, ABREAST = ("x", "y", "heading", "speed", "acceleration", "steering"), 200_000


def simulate(references: DataFrame, dt: float = 0.1) -> DataFrame:
    """references: (token, proposal, t, x, y, heading, speed).  Returns (token, proposal, t, x, y, heading, speed, acceleration, steering)."""

    names = ("x", "y", "heading", "speed")

    def run(batches):
        for batch in batches:
            token, proposal, lists = (batch.column(i) for i in range(3))
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            steps, begin = np.diff(ends), ends[:-1] - ends[0]
            values = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)
            for n in np.unique(steps):
                alike = np.flatnonzero(steps == n)
                for rows in np.array_split(alike, max(1, len(alike) * n // ABREAST)):
                    at = begin[rows, None] + np.arange(n)
                    states = simulate_states(values[at], dt).reshape(-1, 6)
                    each = pa.array(np.repeat(rows, n))
                    yield pa.RecordBatch.from_arrays([token.take(each), proposal.take(each), flat.field("t").take(pa.array(at.ravel())), *map(pa.array, states.T.copy())], ["token", "proposal", "t", *STATE])

    kind = dict(references.dtypes)["token"]
    whole = references.groupBy("token", F.col("proposal").cast("int").alias("proposal")).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("int").alias("t"), *names))).alias("r"))
    return whole.mapInArrow(run, f"token {kind}, proposal int, t int, " + ", ".join(f"{c} double" for c in STATE))


def drive_proposals(starts: DataFrame, steps: int = 40, dt: float = 0.1) -> DataFrame:
    """The columns of starts (token, speed, limit, lead_gap, lead_speed) but speed and limit, and proposal, t and the states of each proposal of unroll_proposals as the
    tracker drives it: made and tracked where the start lies, all of a batch abreast, so no step of a reference is sent anywhere."""
    kept = [c for c in starts.columns if c not in ("speed", "limit")]
    fraction, lateral = np.tile(FRACTIONS, len(LATERALS)), np.repeat(LATERALS, len(FRACTIONS))
    m = len(fraction)

    def run(batches):
        for batch in batches:
            for since in range(0, batch.num_rows, max(1, ABREAST // (m * (steps + 1)))):
                some = batch.slice(since, max(1, ABREAST // (m * (steps + 1))))
                n = some.num_rows
                values = {c: np.repeat(some.column(c).to_numpy(zero_copy_only=False).astype(float), m) for c in ("speed", "limit", "lead_gap", "lead_speed")}
                limit = np.where(np.isnan(values["limit"]), FREE_SPEED, values["limit"])
                s, v = idm_paths(values["speed"], limit * np.tile(fraction, n), values["lead_gap"], values["lead_speed"], steps, dt)
                reference = np.zeros((n * m, steps + 1, 4))
                reference[:, 1:, 0], reference[:, :, 1], reference[:, 0, 3], reference[:, 1:, 3] = s, np.tile(lateral, n)[:, None], values["speed"], v
                states = simulate_states(reference, dt).reshape(-1, 6)
                each = pa.array(np.repeat(np.arange(n), m * (steps + 1)))
                places = [np.tile(np.repeat(np.arange(m, dtype=np.int32), steps + 1), n), np.tile(np.arange(steps + 1, dtype=np.int32), n * m)]
                yield pa.RecordBatch.from_arrays([*[some.column(c).take(each) for c in kept], *map(pa.array, places), *map(pa.array, states.T.copy())], [*kept, "proposal", "t", *STATE])

    kinds = dict(starts.dtypes)
    own = starts.select(*[F.col(c).cast("double").alias(c) if c in ("speed", "limit") else c for c in starts.columns])
    return own.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "proposal int, t int", *[f"{c} double" for c in STATE]]))


def emergency_brake(first_infraction: float, speed: float, limit_time: float = 2.0, limit_speed: float = 5.0) -> bool:
    """Whether the brake path replaces the plan."""
    return first_infraction <= limit_time and speed <= limit_speed
