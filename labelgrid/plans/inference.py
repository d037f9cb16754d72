"""Models over tiles: predictions in batches, averaged over the four ways to flip a tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def flipped(data: Column, height: int, width: int, bands: int, down: bool, across: bool) -> Column:
    """A tile, an array of rows of columns of bands, turned upside down, or left to right, or both."""
    def source(n: Column) -> Column:
        row, col, band = F.floor(n / (width * bands)), F.floor(n / bands) % width, n % bands
        row, col = (height - 1 - row if down else row), (width - 1 - col if across else col)
        return ((row * width + col) * bands + band).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(height * width * bands - 1)), lambda n: F.get(data, source(n)))


def predicted(tiles: DataFrame, column: str, shape: tuple[int, int, int], model: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: int, batch: int = 16) -> DataFrame:
    """tiles with column (height, width, bands; flat, row by row) replaced by the model's class scores (height, width, classes), flat.

    model() is called once in each Python worker, where it may load weights, and gives a function of arrays (n, height, width, bands) to
    (n, height, width, classes). Each tile is scored as it is, upside down, left to right and both; what comes back is
    turned round again and averaged, so a tile and its mirror image have mirrored scores.
    """
    height, width, bands = shape

    def load() -> Callable[[np.ndarray], np.ndarray]:
        score = model()

        def turned(x: np.ndarray, down: bool, across: bool) -> np.ndarray:
            return x[:, :: -1 if down else 1, :: -1 if across else 1]

        def mean(x: np.ndarray) -> np.ndarray:
            said = 0.0
            for down in (False, True):
                for across in (False, True):
                    scores = np.asarray(score(np.ascontiguousarray(turned(x, down, across))), np.float64).reshape(len(x), height, width, classes)
                    said = said + turned(scores, down, across)
            return (said / 4).reshape(len(x), -1)

        return mean

    run = predict_batch_udf(load, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[height, width, bands]])
    return tiles.withColumn(column, run(F.col(column).cast("array<double>")))
