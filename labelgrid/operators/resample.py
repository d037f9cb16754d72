"""Resampling and neighbourhoods of pixel tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import geometry
from . import warp
from .raster import box, windows
from .tables import materialised


def blurred(pixels: DataFrame, keys: list[str], value: str, r: int, sigma: float) -> DataFrame:
    """Gaussian blur over the square of radius r; missing neighbours count as zero."""
    weights = {o: math.exp(-(o[0] ** 2 + o[1] ** 2) / (2 * sigma**2)) for o in box(r)}
    total = sum(weights.values())
    share = [w / total for w in weights.values()]
    values = pixels.withColumn(value, F.col(value).cast("double"))

    def mean(near: np.ndarray, there: np.ndarray) -> pa.Array:
        total = np.zeros(near.shape[1])
        for v, here, w in zip(near, there, share):
            total += np.where(here, v, 0.0) * w
        return pa.array(total)

    return windows(values, keys, value, list(weights), mean, DoubleType())


def resampled(pixels: DataFrame, keys: list[str], value: str, old: tuple[int, int], new: tuple[int, int], kernel: str = "bilinear") -> DataFrame:
    """Images of old (rows, columns) at new, by the kernel nearest, bilinear (4 neighbours) or cubic (16), held at the edges."""
    return warp.resized(pixels, keys, value, old, new, kernel)


def bilinear(pixels: DataFrame, keys: list[str], value: str, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    return resampled(pixels, keys, value, old, new, "bilinear")


def warped(pixels: DataFrame, keys: list[str], value: str, targets: DataFrame, x0: float, y0: float, res: float, height: int, width: int) -> DataFrame:
    """targets (their own columns and x, y) with the value of the nearest source cell, as in a reprojection.

    x and y are where a target lies in the source's coordinates: the inverse map, made by the caller from
    geometry.utm() or any other expression. Targets off the source's grid have null.
    """
    at = geometry.cell(F.col("x"), F.col("y"), x0, y0, res, height, width)
    inside = F.col("x").between(x0, x0 + width * res) & F.col("y").between(y0 - height * res, y0)
    named = pixels.select(*keys, F.col("row").alias("__row"), F.col("col").alias("__col"), value)
    asked = targets.select("*", F.when(inside, at["row"]).alias("__row"), F.when(inside, at["col"]).alias("__col"))
    return asked.join(named, [*keys, "__row", "__col"], "left").drop("__row", "__col")


#: Targets of a bin from which bins are halved, and how often at most.
CROWD, HALVINGS = 64, 24


def nearest_within(points: DataFrame, targets: DataFrame, key: str, target: str, reach: float) -> DataFrame:
    """key and target: the nearest target (x, y) of each point within reach; the smaller target of equals.

    Points meet the targets of the nine bins around theirs. Bins are as small as leaves few targets in each; a point that has
    one within a bin's side has its nearest there, the others go on to bins of twice the side, up to reach. So where
    targets are dense a point meets few of them. Targets at one place are one target.
    """
    targets = targets.groupBy("x", "y").agg(F.min(target).alias(target))
    bin_of = lambda c, side: F.floor(F.col(c) / side).cast("long")
    sides = [float(reach)]
    while len(sides) <= HALVINGS and (targets.groupBy(bin_of("x", sides[-1]), bin_of("y", sides[-1])).count().agg(F.max("count")).first()[0] or 0) > CROWD:
        sides.append(sides[-1] / 2)
    # Points at one place ask once.
    found, left = None, points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct()
    for side in reversed(sides):
        around = lambda c, side=side: F.explode(F.sequence(bin_of(c, side) - 1, bin_of(c, side) + 1))
        # The targets around a bin are one array, so a place stays one row.
        near = targets.select(target, F.col("x").alias("__x"), F.col("y").alias("__y"), around("x").alias("__bx")).withColumn("__by", around("__y"))
        near = near.groupBy("__bx", "__by").agg(F.collect_list(F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"), F.col(target).alias("t"))).alias("__near"))
        met = left.select("*", bin_of("x", side).alias("__bx"), bin_of("y", side).alias("__by")).join(near, ["__bx", "__by"])
        apart = lambda t: (F.col("x") - t["x"]) * (F.col("x") - t["x"]) + (F.col("y") - t["y"]) * (F.col("y") - t["y"])
        first = F.array_min(F.transform("__near", lambda t: F.struct(apart(t).alias("__d2"), t["t"].alias("__t"))))
        here = met.select("x", "y", F.inline(F.array(first))).where(F.col("__d2") <= side * side)
        if len(sides) > 1:
            here = materialised(here)
            left = materialised(left.join(here.select("x", "y"), ["x", "y"], "left_anti"))
        found = here if found is None else found.unionByName(here)
    # Rows of one key, if there are several, have one nearest target.
    return points.select(key, "x", "y").join(found, ["x", "y"]).groupBy(key).agg(F.min_by("__t", F.struct("__d2", "__t")).alias(target))
