"""Search for the best of many settings by a model of the trials so far.

Settings are rows with a place in the unit square. A model of second degree is fitted to the trials from their weighted
moments, sums that one aggregate gives; those near the best trial weigh more. Each round tries the settings from which
most improvement is expected, several at once, spread over the square. All of it follows from the settings and the
objective, so a search that is run again tries the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.session import checkpointed

#: Cells of the unit square, along each side, of which a round tries one setting at most.
SPREAD = 8
TRIAL = "setting bigint, u double, v double, value double, round int"


def unit(c: Column, low: float, high: float) -> Column:
    """A parameter's place between its bounds."""
    return ((c - low) / float(high - low)).cast("double") if high > low else F.lit(0.0)


def _terms(u: Column, v: Column) -> list[Column]:
    return [F.lit(1.0), u, v, u * u, u * v, v * v]


def moments(trials: DataFrame, reach: float) -> dict[str, float]:
    """The sums that a model of second degree is fitted from, and the best trial, in one row.

    Trials weigh by their distance from the best one, half at `reach`, and a thousandth at least.
    """
    best = trials.orderBy(F.col("value").desc(), "setting").limit(1).select(F.col("u").alias("bu"), F.col("v").alias("bv"), F.col("value").alias("best"))
    t = trials.join(F.broadcast(best))  # one row
    far = (F.col("u") - F.col("bu")) ** 2 + (F.col("v") - F.col("bv")) ** 2
    t = t.withColumn("w", F.greatest(F.pow(F.lit(0.5), far / reach**2), F.lit(0.001)))
    x = _terms(F.col("u"), F.col("v"))
    sums = [F.sum(F.col("w") * x[i] * x[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)]
    sums += [F.sum(F.col("w") * x[i] * F.col("value")).alias(f"b{i}") for i in range(6)]
    sums += [F.sum(F.col("w") * F.col("value") ** 2).alias("zz"), F.sum("w").alias("w"), F.max("best").alias("best"), F.max("bu").alias("bu"), F.max("bv").alias("bv"), F.var_pop("value").alias("var")]
    return t.agg(*sums).first().asDict()


def expected(settings: DataFrame, m: dict[str, float], reach: float) -> DataFrame:
    """settings with `gain`, the improvement on the best trial that the model expects of each."""
    a = np.array([[m[f"a{min(i, j)}{max(i, j)}"] for j in range(6)] for i in range(6)])
    b = np.array([m[f"b{i}"] for i in range(6)])
    inverse = np.linalg.pinv(a + 1e-9 * np.trace(a) * np.eye(6))
    c = inverse @ b
    noise = max((m["zz"] - c @ b) / m["w"], 1e-12 * (1 + m["var"]))
    x = _terms(F.col("u"), F.col("v"))
    mean = sum((F.lit(float(c[i])) * x[i] for i in range(1, 6)), F.lit(float(c[0])))
    spread = sum((F.lit(float(inverse[i, j])) * x[i] * x[j] for i in range(6) for j in range(6)), F.lit(0.0))
    # beyond its reach the model is trusted less
    far = ((F.col("u") - m["bu"]) ** 2 + (F.col("v") - m["bv"]) ** 2) / reach**2
    deviation = F.sqrt(noise * (1 + F.greatest(spread, F.lit(0.0))) + 0.001 * m["var"] * F.least(far, F.lit(1.0)))
    s = settings.withColumn("_d", deviation).withColumn("_z", (mean - m["best"]) / F.col("_d"))
    # a logistic curve stands for the normal distribution function
    below = 1 / (1 + F.exp(-1.702 * F.col("_z")))
    gain = F.col("_d") * (F.col("_z") * below + F.exp(-F.col("_z") * F.col("_z") / 2) / float(np.sqrt(2 * np.pi)))
    return s.withColumn("gain", gain).drop("_d", "_z")


def first_settings(settings: DataFrame, n: int) -> DataFrame:
    """About n settings that are spread evenly: of each cell of the square that nearest to its middle, the smallest on ties."""
    side = max(1, int(np.ceil(np.sqrt(n))))
    cell = lambda c: F.least(F.floor(F.col(c) * side), F.lit(side - 1))
    near = F.abs(F.col("u") * side - F.col("_cu") - 0.5) + F.abs(F.col("v") * side - F.col("_cv") - 0.5)
    s = settings.withColumn("_cu", cell("u")).withColumn("_cv", cell("v"))
    return s.groupBy("_cu", "_cv").agg(F.min(F.struct(near.alias("far"), *settings.columns)).alias("s")).select(*(f"s.{c}" for c in settings.columns))


def search(settings: DataFrame, objective: Callable[[DataFrame], DataFrame], first: int = 9, rounds: int = 6, batch: int = 4, reach: float = 0.3) -> DataFrame:
    """The trials (setting, u, v, value, round) of a search for the setting (setting, u, v) of greatest value.

    objective takes settings and gives (setting, value), in one job for a round; a setting without value is worth the
    least that was seen. Round 0 tries about `first` settings, spread evenly, each further round the `batch` with the
    greatest expected gain, of each cell of a grid one at most. The reach of the model halves every other round. The
    search ends early when every setting was tried.
    """
    def tried(chosen: DataFrame, number: int) -> DataFrame:
        chosen = checkpointed(chosen.select("setting", "u", "v"))
        values = objective(chosen).select("setting", F.col("value").cast("double").alias("value"))
        return checkpointed(chosen.join(values, "setting", "left").withColumn("round", F.lit(number)).select("setting", "u", "v", "value", "round"))

    trials = tried(first_settings(settings, first), 0)
    for number in range(1, rounds + 1):
        here = max(reach * 0.5 ** ((number - 1) // 2), 0.02)
        least = trials.agg(F.min("value")).first()[0]
        known = trials.withColumn("value", F.coalesce("value", F.lit(0.0 if least is None else least)))
        left = settings.join(F.broadcast(trials.select("setting")), "setting", "left_anti")  # at most first + rounds * batch rows
        g = expected(left, moments(known, here), here)
        side = max(SPREAD, int(SPREAD / here / 2))
        cell = [F.floor(F.col(c) * side).alias(f"_c{c}") for c in "uv"]
        best = g.groupBy(*cell).agg(F.min(F.struct((-F.col("gain")).alias("loss"), "setting", "u", "v")).alias("s")).select("s.*")
        chosen = checkpointed(best.orderBy("loss", "setting").limit(batch))
        if chosen.limit(1).count() == 0:
            break
        trials = trials.unionByName(tried(chosen, number))
    return trials
