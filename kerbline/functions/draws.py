"""Random numbers by counter: each draw is a digest of what it is for, so that a draw repeats on any cluster and in any engine.

A uniform number is made of the first 52 bits of md5 of the keys, the seed and the stream, joined by colons.  The `_sql`
forms say the same for a database, so that every drawn row can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of a digest that make a number, and how many such numbers there are.
DIGITS, NUMBERS = 13, float(1 << 52)


def bits(keys: list[Column | str], seed: int, stream: int = 0) -> Column:
    """52 bits as a long; a null key counts as an empty one."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws(":", *parts, F.lit(str(seed)), F.lit(str(stream))).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def uniform(keys: list[Column | str], seed: int, stream: int = 0) -> Column:
    """In (0, 1), never an end."""
    return (bits(keys, seed, stream) + 0.5) / NUMBERS


def gumbel(keys: list[Column | str], seed: int, stream: int = 0) -> Column:
    """Standard Gumbel noise: the largest of logit plus noise is a draw by exp(logit)."""
    return -F.log(-F.log(uniform(keys, seed, stream)))


def normal_pair(keys: list[Column | str], seed: int, stream: int = 0) -> tuple[Column, Column]:
    """Two independent standard normal deviates, from two streams."""
    radius, angle = F.sqrt(-2 * F.log(uniform(keys, seed, stream))), 2 * F.pi() * uniform(keys, seed, stream + 1)
    return radius * F.cos(angle), radius * F.sin(angle)


def uniform_sql(keys: list[str], seed: int, stream: int = 0) -> str:
    text = " || ':' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"((CAST('0x' || substr(md5({text} || ':{seed}:{stream}'), 1, {DIGITS}) AS BIGINT) + 0.5e0) / {NUMBERS:.0f}e0)"


def gumbel_sql(keys: list[str], seed: int, stream: int = 0) -> str:
    return f"(-ln(-ln({uniform_sql(keys, seed, stream)})))"


def normal_pair_sql(keys: list[str], seed: int, stream: int = 0) -> tuple[str, str]:
    radius, angle = f"sqrt(-2 * ln({uniform_sql(keys, seed, stream)}))", f"(2 * pi() * {uniform_sql(keys, seed, stream + 1)})"
    return f"({radius} * cos{angle})", f"({radius} * sin{angle})"
