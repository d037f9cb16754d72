"""Images read at places between their pixels: resampling, warps and reprojection, block by block.

A place asks one block of the source, which a task holds with the rows and columns around it that a kernel needs; so a place
is one row of the shuffle whatever its kernel, and a source pixel is one, or up to four near a block's corner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .relational import with_groups
from .tables import materialised

#: Rows and columns of a block of the source, and pixels around it that a kernel may need.
BLOCK, HALO = 128, 2
#: Places of a block that one task reads at once.
PLACES = 1 << 19
#: Pixels of blocks, and places, that a task's group has when blocks are small.
PACKED_PIXELS, PACKED_PLACES = 1 << 20, 1 << 17
KERNELS = {"nearest": 0, "bilinear": 1, "cubic": 2}


def _weights(t: np.ndarray, kernel: str) -> tuple[range, np.ndarray]:
    """Steps from the pixel below a place to those its value is made of, and their weights for the part t of a pixel."""
    if kernel == "bilinear":
        return range(0, 2), np.stack([1 - t, t])
    near = lambda d: 1.5 * d**3 - 2.5 * d**2 + 1  # noqa: E731  cubic convolution with a = -1/2
    far = lambda d: -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2
    return range(-1, 3), np.stack([far(t + 1), near(t), near(1 - t), far(2 - t)])


def _read(held: np.ndarray, cell: np.ndarray, y: np.ndarray, x: np.ndarray, kernel: str, zero: bool) -> np.ndarray:
    """Values of the blocks held at places y, x of cells' pixels' centres; nearest is null where its pixel is, the others are made of the pixels there are."""
    if kernel == "nearest":
        return held[cell, np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int)]
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    (rows, u), (cols, v) = _weights(y - i, kernel), _weights(x - j, kernel)
    total, weight, some = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y), bool)
    for a, di in enumerate(rows):
        for b, dj in enumerate(cols):
            value, w = held[cell, i + di, j + dj], u[a] * v[b]
            there = ~np.isnan(value)
            total[there] += w[there] * value[there]
            weight[there] += w[there]
            some |= there
    if zero:
        return np.where(some, total, np.nan)
    whole = np.abs(weight - 1) < 1e-9
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole, total, np.where(weight > 0.5, total / weight, np.nan))


def sampled(pixels: DataFrame, keys: list[str], value: str, places: DataFrame, sizes: DataFrame, kernel: str = "bilinear", block: int | None = None, zero: bool = False) -> DataFrame:
    """places (keys, sy, sx and columns of their own) with the value of pixels (keys, row, col, value) there.

    sy and sx count in pixels of the source, whose centres are whole numbers; sizes has (keys, height, width) of each image.
    Kernels are nearest, bilinear and cubic; pixels beyond an edge are those on it, absent and null ones are left out
    of the mean and a place with less than half its weight in pixels is null; or they count as zero, and only a place without a pixel is
    null. Places more than half a pixel outside, or null, are null.
    """
    block = block or BLOCK
    if block < 2 * HALO:
        raise ValueError(f"blocks have at least {2 * HALO} rows")
    near = places.join(sizes.select(*keys, F.col("height").alias("__h"), F.col("width").alias("__w")), keys) if keys else places.join(F.broadcast(sizes.select(F.col("height").alias("__h"), F.col("width").alias("__w"))))
    hold = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c).cast("double"), F.col(n) - 1.0))
    of = lambda c: F.floor(c / block).cast("long")
    asked = near.withColumns({"__y": F.col("sy").cast("double"), "__x": F.col("sx").cast("double"), "__br": of(hold("sy", "__h")), "__bc": of(hold("sx", "__w"))})
    asked = materialised(asked)  # places are often reckoned at some cost, and are read several times here
    inside = (F.col("__y") >= -0.5) & (F.col("__x") >= -0.5) & (F.col("__y") <= F.col("__h") - 0.5) & (F.col("__x") <= F.col("__w") - 0.5)
    own = [c for c in places.columns if c not in keys]
    cell = [*keys, "__br", "__bc"]
    met = asked.where(inside)
    counts = materialised(met.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n")))
    # A block that very many places ask for is held by several tasks, each with some of the places.
    crowded = counts.select(*cell, F.ceil(F.col("__n") / PLACES).alias("__n")).where("__n > 1")
    shares = not crowded.isEmpty()
    # Pixels go to their own block and to those whose rim they are in.
    lap = lambda c: F.array_distinct(F.transform(F.array(F.lit(-HALO), F.lit(0), F.lit(HALO)), lambda d: F.floor((F.col(c) + d) / block).cast("long")))
    source = pixels.select(*[F.col(k).cast(met.schema[k].dataType).alias(k) for k in keys], "row", "col", F.col(value).cast("double").alias("__v")).withColumn("__br", F.explode(lap("row"))).withColumn("__bc", F.explode(lap("col")))
    if shares:
        n = F.coalesce("__n", F.lit(1))
        met = with_groups(met, crowded, cell, "left").withColumn("__part", F.pmod(F.xxhash64("__y", "__x"), n)).drop("__n")
        source = with_groups(source, crowded, cell, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("__n")
        cell = [*cell, "__part"]
    # Small blocks go to a task many at a time: as many as have some ten thousands of places and some millions of pixels.
    side = block + 2 * HALO
    n_cells, n_places = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()
    packs = 1 + max(n_cells * side * side // PACKED_PIXELS, n_places // PACKED_PLACES)
    pack = F.pmod(F.xxhash64(*cell), F.lit(packs))
    met = met.withColumn("__pack", pack)
    place_kinds = [met.schema[c] for c in (*keys, *own)]

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c.name: [] for c in place_kinds} | {value: []})
        b = b.rename(columns={f"__k{i}": c for i, c in enumerate(cell)})
        of = a.groupby(cell, dropna=False, sort=False).ngroup().to_numpy()
        first = a.iloc[np.unique(of, return_index=True)[1]]
        b = b.merge(first[cell].assign(__of=np.arange(len(first))), on=cell)
        r0, c0 = (first[c].to_numpy().astype(np.int64) * block - HALO for c in ("__br", "__bc"))
        found = np.full(len(a), np.nan)
        by, bx, bv, bof = b["row"].to_numpy(), b["col"].to_numpy(), b["__v"].to_numpy(float), b["__of"].to_numpy()
        ay, ax = a["__y"].to_numpy(), a["__x"].to_numpy()
        step = max(1, PACKED_PIXELS // (side * side))
        for s in range(0, len(first), step):  # so many blocks are held at a time
            mine, theirs = (of >= s) & (of < s + step), (bof >= s) & (bof < s + step)
            k, p = of[mine] - s, bof[theirs] - s
            o = r0[s : s + step], c0[s : s + step]
            held = np.full((len(o[0]), side, side), np.nan)
            i, j = by[theirs] - o[0][p], bx[theirs] - o[1][p]
            kept = (i >= 0) & (i < side) & (j >= 0) & (j < side)
            held[p[kept], i[kept], j[kept]] = bv[theirs][kept]
            sizes = (first[c].to_numpy().astype(np.int64)[s : s + step, None] for c in ("__h", "__w"))
            rows, cols = (np.clip(np.clip(np.arange(side) + low[:, None], 0, n - 1) - low[:, None], 0, side - 1) for low, n in zip(o, sizes))
            held = held[np.arange(len(held))[:, None, None], rows[:, :, None], cols[:, None, :]]
            found[mine] = _read(held, k, ay[mine] - o[0][k], ax[mine] - o[1][k], kernel, zero)
        return a[[c.name for c in place_kinds]].assign(**{value: pd.Series(found, index=a.index).replace({np.nan: None})})

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in place_kinds), f"`{value}` double"])
    # Under other names, since places are often made from the pixels themselves.
    source = source.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(cell)], "row", "col", "__v", pack.alias("__kp"))
    found = met.groupBy("__pack").cogroup(source.groupBy("__kp")).applyInPandas(one, ddl)
    return found.unionByName(asked.where(~inside | F.col("sy").isNull() | F.col("sx").isNull()).select(*keys, *own).withColumn(value, F.lit(None).cast("double")))


def _grid(layouts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col and the columns of layouts): every pixel of images of (height, width)."""
    axis = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    return layouts.withColumn("row", axis("height")).withColumn("col", axis("width"))


def resized(pixels: DataFrame, keys: list[str], value: str, old: tuple[int, int], new: tuple[int, int], kernel: str = "bilinear", block: int | None = None) -> DataFrame:
    """(keys, row, col, value): images of old (rows, columns) at new; outer edges stay where they are.

    Absent pixels count as zero; where all pixels that a new one is made of are absent it is too.
    """
    images = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).drop("id")
    sizes = images.withColumns({"height": F.lit(old[0]), "width": F.lit(old[1])})
    grid = _grid(images.withColumns({"height": F.lit(new[0]), "width": F.lit(new[1])}), keys).select(*keys, "row", "col")
    between = lambda c, a, b: (F.col(c) + 0.5) * F.lit(a / b) - 0.5
    places = grid.withColumns({"sy": between("row", old[0], new[0]), "sx": between("col", old[1], new[1])})
    return sampled(pixels, keys, value, places, sizes, kernel, block, zero=True).where(F.col(value).isNotNull()).select(*keys, "row", "col", value)


def target_layouts(layouts: DataFrame, keys: list[str], epsg: int, res: float | None = None) -> DataFrame:
    """(keys, height, width, x0, y0, dx, dy) in metres of UTM for layouts (keys, height, width, x0, y0, dx, dy) in degrees.

    The grid covers the extent of points along the source's four sides. Its pixels are square: res, or the source's diagonal
    over as many pixels as it has.
    """
    c = F.col
    south, east = c("y0") - c("height") * c("dy"), c("x0") + c("width") * c("dx")
    boxed = layouts.withColumn("b", geometry.utm_bounds(south, c("x0"), c("y0"), east, epsg))
    span = F.hypot(c("b.x1") - c("b.x0"), c("b.y1") - c("b.y0")) / F.hypot(c("width"), c("height"))
    sized = boxed.withColumn("r", F.lit(res).cast("double") if res else span)
    n = lambda a, b: F.greatest(F.lit(1), F.ceil((c(f"b.{b}") - c(f"b.{a}")) / c("r") - 1e-9)).cast("int")
    return sized.select(*keys, n("y0", "y1").alias("height"), n("x0", "x1").alias("width"), c("b.x0").alias("x0"), c("b.y1").alias("y0"), c("r").alias("dx"), c("r").alias("dy"))


def _asked(grid: DataFrame, keys: list[str], at: Column, y: str, x: str) -> DataFrame:
    """(keys, row, col, sy, sx): where the points at (y, x) of grid lie in pixels of the source."""
    # As a row of its own the point is reckoned once, and not anew in each condition on it.
    found = grid.select(*keys, "row", "col", *[F.col(f"__{c}") for c in ("x0", "y0", "dx", "dy")], F.inline(F.array(at)))
    return found.select(*keys, "row", "col", ((F.col("__y0") - F.col(y)) / F.col("__dy") - 0.5).alias("sy"), ((F.col(x) - F.col("__x0")) / F.col("__dx") - 0.5).alias("sx"))


def to_utm(pixels: DataFrame, keys: list[str], value: str, layouts: DataFrame, targets: DataFrame, epsg: int, kernel: str = "nearest", block: int | None = None) -> DataFrame:
    """(keys, row, col, value): images in degrees (layouts as for target_layouts()) on the grids targets in metres of UTM.

    Each target pixel's centre is taken back to degrees and read there; null outside the source.
    """
    source = layouts.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "dx", "dy")])
    grid = _grid(targets, keys).join(source, keys)
    at = geometry.lat_lon(F.col("x0") + (F.col("col") + 0.5) * F.col("dx"), F.col("y0") - (F.col("row") + 0.5) * F.col("dy"), epsg)
    asked = _asked(grid, keys, at, "lat", "lon")
    return sampled(pixels, keys, value, asked, layouts.select(*keys, "height", "width"), kernel, block).select(*keys, "row", "col", value)


def to_degrees(pixels: DataFrame, keys: list[str], value: str, layouts: DataFrame, targets: DataFrame, epsg: int, kernel: str = "nearest", block: int | None = None) -> DataFrame:
    """(keys, row, col, value): images in metres of UTM (layouts) on the grids targets in degrees; null outside the source."""
    source = layouts.select(*keys, *[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "dx", "dy")])
    grid = _grid(targets, keys).join(source, keys)
    at = geometry.utm(F.col("y0") - (F.col("row") + 0.5) * F.col("dy"), F.col("x0") + (F.col("col") + 0.5) * F.col("dx"), epsg)
    asked = _asked(grid, keys, at, "y", "x")
    return sampled(pixels, keys, value, asked, layouts.select(*keys, "height", "width"), kernel, block).select(*keys, "row", "col", value)


def without_lens(pixels: DataFrame, keys: list[str], value: str, height: int, width: int, camera: list[list[float]], k: tuple[float, ...], p: tuple[float, float], new_camera: list[list[float]], kernel: str = "bilinear", block: int | None = None) -> DataFrame:
    """(keys, row, col, value): images of this size seen through a lens, as new_camera sees them without; null where it sees past the image."""
    images = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).drop("id")
    sizes = images.withColumns({"height": F.lit(height), "width": F.lit(width)})
    x, y = ((F.col(c) - F.lit(float(new_camera[i][2]))) / F.lit(float(new_camera[i][i])) for i, c in enumerate(("col", "row")))
    seen = _grid(sizes, keys).select(*keys, "row", "col", F.inline(F.array(geometry.distorted(x, y, k, p))))
    sy, sx = F.col("y") * F.lit(float(camera[1][1])) + F.lit(float(camera[1][2])), F.col("x") * F.lit(float(camera[0][0])) + F.lit(float(camera[0][2]))
    return sampled(pixels, keys, value, seen.select(*keys, "row", "col", sy.alias("sy"), sx.alias("sx")), sizes, kernel, block).select(*keys, "row", "col", value)
