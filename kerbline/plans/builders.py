"""Extension points: feature builders with a cache, trajectory agents, text annotators.

A builder is a function DataFrame -> DataFrame with a name; its result is keyed by token.  An agent gives
poses per token and says whether it needs more than the history.  An annotator is a text UDF.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.scenes import complete_keys, without_tokens


@dataclass(frozen=True)
class Builder:
    name: str
    build: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Agent:
    """predict: scenes -> (token, step, x, y, heading).  requires_scene: it may see the future frames."""

    name: str
    predict: Callable[[DataFrame], DataFrame]
    requires_scene: bool = False


def cache_features(scenes: DataFrame, builders: list[Builder], path: str, force: bool = False) -> None:
    """One table per builder, partitioned by log; tokens that are there already are not built again."""
    spark = scenes.sparkSession
    for b in builders:
        place = f"{path}/{b.name}"
        left = scenes if force else without_tokens(scenes, cached_tokens(spark, place))
        b.build(left).write.mode("overwrite" if force else "append").partitionBy("log").option("compression", "zstd").parquet(place)


def cached_tokens(spark: SparkSession, place: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(place).select("token")
    except AnalysisException:  # nothing has been cached yet
        return spark.createDataFrame([], "token string")


def usable_tokens(spark: SparkSession, builders: list[Builder], path: str) -> DataFrame:
    """Tokens for which every builder's features exist."""
    parts = None
    for b in builders:
        own = cached_tokens(spark, f"{path}/{b.name}").withColumn("builder", F.lit(b.name))
        parts = own if parts is None else parts.unionByName(own)
    return complete_keys(parts, "token", "builder", len(builders)).select("token")


def constant_velocity(steps: int, dt: float) -> Agent:
    """Straight on at the current speed.  Scenes: token, speed."""

    def predict(scenes: DataFrame) -> DataFrame:
        ahead = scenes.select("token", "speed", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
        return ahead.select("token", "step", (F.col("step") * dt * F.col("speed")).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("heading"))

    return Agent("constant_velocity", predict)


def ground_truth() -> Agent:
    """The recorded future.  Scenes: token, future (array of x, y, heading)."""

    def predict(scenes: DataFrame) -> DataFrame:
        ahead = scenes.select("token", F.posexplode("future").alias("_i", "p"))
        return ahead.select("token", (F.col("_i") + 1).alias("step"), "p.x", "p.y", "p.heading")

    return Agent("ground_truth", predict, requires_scene=True)


def run_agent(agent: Agent, scenes: DataFrame, privileged: tuple[str, ...] = ("future",)) -> DataFrame:
    """An agent sees the future only if it says that it needs it."""
    return agent.predict(scenes if agent.requires_scene else scenes.drop(*[c for c in privileged if c in scenes.columns]))


def annotate(samples: DataFrame, generate: Callable[[Column], Column], prompt: str, name: str = "cot_text") -> DataFrame:
    """Text from a pluggable generator (a text UDF); a failure is the empty text."""
    return samples.withColumn(name, F.coalesce(generate(F.col(prompt)), F.lit("")))


# ------------------------------------------------------------------ generators that may fail
#: Makers of generators by name; a generator takes prompts and returns a text for each, or raises.
BACKENDS: dict[str, Callable[..., Callable[[list[str]], list[str]]]] = {}


def backend(name: str) -> Callable:
    """Register a maker of generators."""

    def add(make: Callable) -> Callable:
        BACKENDS[name] = make
        return make

    return add


def annotate_with_retries(
    samples: DataFrame,
    make: str | Callable[..., Callable[[list[str]], list[str]]],
    prompt: str,
    batch: int = 32,
    retries: int = 3,
    delay: float = 5.0,
    sleep: Callable[[float], None] = time.sleep,
    **options,
) -> DataFrame:
    """samples with cot_text, attempts and error: texts of a generator that is asked in batches and may fail.

    make: a registered name or a maker, called once a task with the options.  A batch that fails is asked again prompt by
    prompt, up to `retries` times in all, after a wait of `delay` times the number of the attempt, so one bad prompt does
    not cost its neighbours anything.  A prompt that fails to the last has an empty text and the error's message; a null
    prompt is not asked.  No failure ends the job.  sleep: the clock, replaced in tests.
    """
    maker = BACKENDS[make] if isinstance(make, str) else make
    columns = samples.columns

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = maker(**options)

        def ask(prompts: list[str], attempt: int) -> list[tuple[str, int, str | None]]:
            try:
                texts = generate(prompts)
                if len(texts) != len(prompts):
                    raise RuntimeError(f"{len(texts)} texts for {len(prompts)} prompts")
                return [(t or "", attempt, None) for t in texts]
            except Exception as e:
                if attempt >= retries and len(prompts) == 1:
                    return [("", attempt, f"{type(e).__name__}: {e}")]
                if attempt < retries:
                    sleep(delay * attempt)
                return [x for p in prompts for x in ask([p], min(attempt + 1, retries))]

        for pdf in stream:
            found: list[tuple[str, int, str | None]] = [("", 0, None)] * len(pdf)
            asked = [i for i, p in enumerate(pdf[prompt]) if isinstance(p, str)]
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                for i, x in zip(some, ask([pdf[prompt].iloc[i] for i in some], 1), strict=True):
                    found[i] = x
            texts, attempts, errors = zip(*found, strict=True) if found else ((), (), ())
            yield pdf.assign(cot_text=list(texts), attempts=list(attempts), error=pd.Series(errors, index=pdf.index, dtype=object))[[*columns, "cot_text", "attempts", "error"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInPandas(run, f"{kinds}, cot_text string, attempts int, error string")
