"""Dense CRF by exact mean-field on small tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import raster


def mean_field(unary: np.ndarray, places: np.ndarray, features: np.ndarray, theta: tuple[float, float, float], weights: tuple[float, float], steps: int) -> np.ndarray:
    """Probabilities (n, k) from unary energies, a Gaussian on places and one on places and features.

    Kernels are normalised symmetrically; labels that differ cost one (Potts).
    """
    alpha, beta, gamma = theta
    near = ((places[:, None] - places[None]) ** 2).sum(-1)
    alike = ((features[:, None] - features[None]) ** 2).sum(-1)

    def kernel(k: np.ndarray) -> np.ndarray:
        k = k - np.diag(np.diag(k))
        scale = 1 / np.sqrt(k.sum(1) + 1e-20)
        return k * scale[:, None] * scale[None]

    pull = weights[0] * kernel(np.exp(-near / (2 * gamma**2))) + weights[1] * kernel(np.exp(-near / (2 * alpha**2) - alike / (2 * beta**2)))
    q = None
    for _ in range(steps + 1):
        energy = -unary if q is None else -unary + pull @ q
        q = np.exp(energy - energy.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    return q


def refined(tiles: DataFrame, key: str, classes: int, theta=(20.0, 5.0, 3.0), weights=(3.0, 5.0), steps: int = 5, most: int = 4096) -> DataFrame:
    """(key, row, col, label, prob, classes) of tiles (key, row, col, probs, features): a task holds one tile of at most `most` pixels.

    classes has the refined probability of every class. Larger images go through refined_in_patches().
    """
    kind = tiles.schema[key].dataType.simpleString()

    def run(t: pd.DataFrame) -> pd.DataFrame:
        if len(t) > most:
            raise ValueError(f"a tile of {len(t)} pixels; cut it to {most}")
        t = t.sort_values(["row", "col"])
        probs = np.stack(t["probs"].to_numpy())[:, :classes].astype(float)
        q = mean_field(
            -np.log(np.clip(probs, 0, 1) + 1e-3), t[["row", "col"]].to_numpy(float), np.stack(t["features"].to_numpy()).astype(float), theta, weights, steps
        )
        return pd.DataFrame({key: t[key], "row": t["row"], "col": t["col"], "label": q.argmax(1), "prob": q.max(1), "classes": list(q)})

    return tiles.groupBy(key).applyInPandas(run, f"{key} {kind}, row int, col int, label int, prob double, classes array<double>")


def refined_in_patches(
    pixels: DataFrame, keys: list[str], height: int, width: int, classes: int, patch: int = 48, stride: int = 32, theta=(20.0, 5.0, 3.0), weights=(3.0, 5.0), steps: int = 5
) -> DataFrame:
    """(keys, row, col, label, prob): images (keys, row, col, probs, features) of any size, refined patch by patch.

    The last patches of a row or column hang over the image's edge and hold what there is of it. What
    overlapping patches say of a pixel is averaged by raster.taper, class by class; the best class is taken
    at the end. patch squared bounds a task's pixels.
    """
    cut = raster.in_patches(pixels.select(*keys, "row", "col", "probs", "features"), height, width, patch, stride)
    own = F.to_json(F.struct(*keys, "pr", "pc")).alias("__patch")
    tiles = cut.select(own, "row", "col", "probs", "features")
    said = refined(tiles, "__patch", classes, theta, weights, steps, patch * patch)
    schema = ", ".join([*(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys), "pr int", "pc int"])
    back = said.select(F.from_json("__patch", schema).alias("p"), "row", "col", "classes").select("p.*", "row", "col", "classes")
    placed = back.withColumn("i", F.col("row") - F.col("pr") * stride).withColumn("j", F.col("col") - F.col("pc") * stride)
    w = raster.taper(F.col("i"), F.col("j"), patch, stride)
    one = [(F.sum(w * F.get("classes", F.lit(c))) / F.sum(w)) for c in range(classes)]
    mixed = placed.groupBy(*keys, "row", "col").agg(F.array(*one).alias("__q"))
    return mixed.select(*keys, "row", "col", arrays.argmax(F.col("__q")).alias("label"), F.array_max("__q").alias("prob"))
