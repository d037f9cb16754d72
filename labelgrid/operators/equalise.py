"""Adaptive histogram equalisation: a map of grey values for each tile, blended between tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_maps(pixels: DataFrame, keys: list[str], value: str, tile: int, clip: float = 2.0, levels: int = 256) -> DataFrame:
    """(keys, ti, tj, level, mapped): where each tile of tile by tile pixels sends the grey values 0 to levels - 1.

    Of a tile's histogram what exceeds clip times its mean goes to all levels in equal shares, whole pixels and the remainder
    to the lowest ones; a value is sent to the share of pixels up to it. Tiles at the far edges may be smaller. Null pixels count for nothing.
    """
    at = [*keys, "ti", "tj"]
    tiled = pixels.where(F.col(value).isNotNull()).select(*keys, F.floor(F.col("row") / tile).cast("int").alias("ti"), F.floor(F.col("col") / tile).cast("int").alias("tj"), F.col(value).cast("int").alias("level"))
    counts = tiled.groupBy(*at, "level").agg(F.count(F.lit(1)).alias("n"))
    # A tile has as many levels as there are grey values, so its histogram is one short array.
    hist = counts.groupBy(*at).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("h"), F.sum("n").alias("all"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(float(clip)) * F.col("all") / levels)).cast("long")
    cut = hist.withColumn("limit", limit).withColumn(
        "h", F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.coalesce(F.try_element_at("h", k), F.lit(0).cast("long")))
    )
    over = F.aggregate("h", F.lit(0).cast("long"), lambda s, n: s + F.greatest(F.lit(0).cast("long"), n - F.col("limit")))
    rest = cut.withColumn("over", over).select(*at, "all", "limit", "over", F.posexplode("h").alias("level", "n"))
    share = F.floor(F.col("over") / levels) + F.when(F.col("level") < F.col("over") % levels, 1).otherwise(0)
    upto = Window.partitionBy(*at).orderBy("level")
    return rest.select(*at, "level", (F.sum(F.least("n", "limit") + share).over(upto) * (levels - 1) / F.col("all")).alias("mapped"))


def _between(c: str, tile: int, most: Column) -> Column:
    """Array of (tile, weight) of the two tiles whose middles are around a pixel; beyond the outermost middles one tile alone."""
    at = (F.col(c) + 0.5) / tile - 0.5
    low = F.floor(at).cast("int")
    hold = lambda k: F.greatest(F.lit(0), F.least(k, most))
    return F.array(F.struct(hold(low).alias("t"), (1 - (at - low)).alias("w")), F.struct(hold(low + 1).alias("t"), (at - low).alias("w")))


def equalised(pixels: DataFrame, keys: list[str], value: str, height: int, width: int, tile: int = 64, clip: float = 2.0, levels: int = 256) -> DataFrame:
    """pixels with value, a grey level from 0 to levels - 1, sent through the maps of the four tiles around it, by nearness.

    A tile's maps go to its pixels and those of its neighbours as one array for each tile, so pixels are joined once, with the nine tiles around.
    """
    last = {"row": (height - 1) // tile, "col": (width - 1) // tile}
    maps = tile_maps(pixels, keys, value, tile, clip, levels).groupBy(*keys, "ti", "tj").agg(F.array_sort(F.collect_list(F.struct("level", "mapped"))).getField("mapped").alias("map"))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    spread = maps.select(*keys, "ti", "tj", "map", around("ti").alias("__i")).withColumn("__j", around("tj"))
    near = spread.groupBy(*keys, "__i", "__j").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ti", "tj").alias("t"), "map"))).alias("__maps"))  # nine at most
    placed = pixels.withColumns({"__i": F.floor(F.col("row") / tile).cast("int"), "__j": F.floor(F.col("col") / tile).cast("int")})
    met = placed.join(near, [*keys, "__i", "__j"], "left").withColumns({"__r": _between("row", tile, F.lit(last["row"])), "__c": _between("col", tile, F.lit(last["col"]))})
    found = lambda a, b: F.get(F.try_element_at("__maps", F.struct(a["t"].alias("ti"), b["t"].alias("tj"))), F.col(value).cast("int"))
    corners = [(F.col("__r")[i], F.col("__c")[j]) for i in (0, 1) for j in (0, 1)]
    parts = [F.coalesce(found(a, b), F.lit(0.0)) * a["w"] * b["w"] for a, b in corners]
    weights = [F.when(found(a, b).isNotNull(), a["w"] * b["w"]).otherwise(0.0) for a, b in corners]
    mixed = F.try_divide(parts[0] + parts[1] + parts[2] + parts[3], weights[0] + weights[1] + weights[2] + weights[3])
    return met.withColumn(value, F.when(F.col(value).isNotNull(), mixed)).select(*pixels.columns)
