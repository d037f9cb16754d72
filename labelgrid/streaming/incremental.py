"""An extension: confusion counts that grow as batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_stream(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Streaming form of operators.metrics.confusion(), for update or complete mode.

    State is one count for each key and cell, so it is bounded by keys times k squared.
    """
    return rows.where(F.col("gt").between(0, k - 1)).groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))
