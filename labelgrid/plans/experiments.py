"""Experiment plans: grids of settings, parameter search and sensor noise."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import materialised


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """One row for each combination of the axes' values."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def unit(*parts: Column) -> Column:
    """A number from 0 to below 1, drawn by the MD5 of the parts' text: any engine with MD5 draws the same."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def random_search(spark: SparkSession, trials: int, ranges: dict[str, tuple[float, float, str]], seed: int) -> DataFrame:
    """(trial, a column for each parameter): drawn evenly from [low, high], whole numbers for int.

    Draws are hashes of seed, trial and name, so a trial is the same whatever the partitions.
    """
    def draw(name: str, low: float, high: float, kind: str) -> Column:
        at = unit(F.lit(seed), F.col("trial"), F.lit(name))
        if kind == "int":
            return (F.lit(int(low)) + F.floor(at * F.lit(int(high) - int(low) + 1))).cast("int").alias(name)
        return (F.lit(low) + at * F.lit(high - low)).alias(name)

    return spark.range(trials).select(F.col("id").alias("trial")).select("trial", *[draw(n, *r) for n, r in ranges.items()])


#: Trials that are broadcast at once.
TOGETHER = 4096


def evaluated(trials: DataFrame, data: DataFrame, loss: Column, keys: list[str]) -> DataFrame:
    """Mean loss of every trial over data.

    Trials are broadcast, up to TOGETHER at once, and losses are summed up before anything is shuffled; data is read once for each
    TOGETHER trials.
    """
    n = trials.count()
    if n <= TOGETHER:
        return data.join(F.broadcast(trials)).groupBy(*keys).agg(F.avg(loss).alias("loss"))
    slices = -(-n // (TOGETHER // 2))
    dealt = materialised(trials.withColumn("__slice", F.monotonically_increasing_id() % slices))
    each = [evaluated(dealt.where(F.col("__slice") == k).drop("__slice"), data, loss, keys) for k in range(slices)]
    return functools.reduce(DataFrame.unionByName, each)


def noise(sigma: Column, *key: Column, seed: int) -> Column:
    """Normal noise of deviation sigma, fixed by seed and key (Box-Muller on hashes)."""
    draw = lambda n: unit(F.lit(seed), F.lit(n), *key)
    return sigma * F.sqrt(-2 * F.ln(1 - draw(0))) * F.cos(F.lit(6.283185307179586) * draw(1))
