"""Raster algebra on pixel tables (image keys, row, col, value)."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from ..functions import arrays
from .metrics import exact_percentile
from .relational import with_groups


def box(r: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)]


def disk(r: int) -> list[tuple[int, int]]:
    return [(i, j) for i, j in box(r) if i * i + j * j <= r * r]


#: Rows and columns of a block; a task's group is a block and its halo.
FOCAL_BLOCK = 64


def _along(a: np.ndarray, r: int, kind: str) -> np.ndarray:
    """Of each place of a's first axis that has r places on both sides, the max, min, sum or bitwise or over it and them."""
    width = 2 * r + 1
    if kind == "sum":
        total = np.concatenate([np.zeros_like(a[:1]), np.cumsum(a, axis=0)])
        return total[width:] - total[:-width]
    op = {"max": np.maximum, "min": np.minimum, "or": np.bitwise_or}[kind]
    size = 1
    while 2 * size <= width:  # runs of twice the length from two that meet
        a, size = op(a[:-size], a[size:]), 2 * size
    return op(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def _neutral(kind: str, dtype: np.dtype):
    if kind in ("sum", "or"):
        return 0
    ends = np.iinfo(dtype) if dtype.kind in "iu" else None
    return (ends.min if kind == "max" else ends.max) if ends else (-np.inf if kind == "max" else np.inf)


def focal_dense(pixels: DataFrame, keys: list[str], value: str, r: int, kind: str) -> DataFrame:
    """max, min, sum or bitwise or over the square of radius r around each pixel; value is a number or an array of doubles of one length.

    Images are cut to blocks, which a task holds with their halo. A pixel goes to its block with all columns, and to those it is in
    the halo of with its value alone. Absent and null neighbours count for nothing.
    """
    out = pixels.schema[value].dataType
    if kind == "sum" and not isinstance(out, ArrayType):
        out = pixels.agg(F.sum(value).alias(value)).schema[value].dataType
    side = FOCAL_BLOCK + 2 * r
    others = [c for c in pixels.columns if c not in (*keys, "row", "col", value)]
    lap = lambda c: F.sequence(F.floor((F.col(c) - r) / FOCAL_BLOCK), F.floor((F.col(c) + r) / FOCAL_BLOCK))
    carried = F.struct(*others) if others else F.lit(0)
    sent = pixels.select(*keys, "row", "col", value, carried.alias("__o"), F.explode(lap("row")).alias("__br")).select("*", F.explode(lap("col")).alias("__bc"))
    own = (F.floor(F.col("row") / FOCAL_BLOCK) == F.col("__br")) & (F.floor(F.col("col") / FOCAL_BLOCK) == F.col("__bc"))
    sent = sent.withColumn("__own", own).withColumn("__o", F.when(own, F.col("__o")))
    kept = [*keys, "row", "col", "__o"]
    schema = StructType([*[sent.schema[c] for c in kept], StructField(value, out)])

    def one(t: pa.Table) -> pa.Table:
        i = t["row"].to_numpy() - t["__br"][0].as_py() * FOCAL_BLOCK + r
        j = t["col"].to_numpy() - t["__bc"][0].as_py() * FOCAL_BLOCK + r
        column = t[value].combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(int(there.sum()), -1)
        else:
            v = column.drop_null().to_numpy(zero_copy_only=False)[:, None]
        dense = np.full((side, side, v.shape[1]), _neutral(kind, v.dtype), v.dtype)
        dense[i[there], j[there]] = v
        held = _along(_along(dense, r, kind).swapaxes(0, 1), r, kind).swapaxes(0, 1)
        mine = t["__own"].to_numpy()
        at_i, at_j = i, j
        i, j, rows = i[mine] - r, j[mine] - r, t.filter(t["__own"])
        found, none = held[i, j], None
        if not there.all():
            seen = np.zeros((side, side, 1), bool)
            seen[at_i[there], at_j[there]] = True
            none = ~_along(_along(seen, r, "or").swapaxes(0, 1), r, "or").swapaxes(0, 1)[i, j, 0]
        if pa.types.is_list(column.type):
            made = pa.FixedSizeListArray.from_arrays(pa.array(found.reshape(-1)), v.shape[1]).cast(column.type)
            made = made if none is None else pc.if_else(pa.array(none), pa.scalar(None, column.type), made)
        else:
            made = pa.array(found[:, 0], mask=none)
        return rows.select(kept).append_column(value, made)

    found = sent.groupBy(*keys, "__br", "__bc").applyInArrow(one, schema)
    return found.select(*[F.col("__o").getField(c).alias(c) if c in others else F.col(c) for c in pixels.columns])


def windows(pixels: DataFrame, keys: list[str], value: str, offsets: list[tuple[int, int]], of: Callable[[np.ndarray, np.ndarray], pa.Array], out: DataType) -> DataFrame:
    """(keys, row, col, value): of(near, there) for the pixels there are; near and there have a row for each offset and a column for each pixel.

    Images are cut to blocks, which a task holds with their halo. A pixel goes to its block and to those it is in the halo of.
    Values must not be null.
    """
    r = max(max(abs(i), abs(j)) for i, j in offsets)
    side = FOCAL_BLOCK + 2 * r
    lap = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / FOCAL_BLOCK), F.floor((F.col(c) + r) / FOCAL_BLOCK)))
    sent = pixels.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).alias("__v"), lap("row").alias("__br")).select("*", lap("col").alias("__bc"))
    kept = [*keys, "row", "col"]
    schema = StructType([*[sent.schema[c] for c in kept], StructField(value, out)])

    def one(t: pa.Table) -> pa.Table:
        i = t["row"].to_numpy() - t["__br"][0].as_py() * FOCAL_BLOCK + r
        j = t["col"].to_numpy() - t["__bc"][0].as_py() * FOCAL_BLOCK + r
        v = t["__v"].to_numpy()
        dense, there = np.zeros((side, side), v.dtype), np.zeros((side, side), bool)
        dense[i, j], there[i, j] = v, True
        mine = (i >= r) & (i < side - r) & (j >= r) & (j < side - r)
        a, b = i[mine], j[mine]
        around = lambda held: np.stack([held[a + di, b + dj] for di, dj in offsets])
        return t.filter(pa.array(mine)).select(kept).append_column(value, of(around(dense), around(there)))

    return sent.groupBy(*keys, "__br", "__bc").applyInArrow(one, schema)


def focal(pixels: DataFrame, keys: list[str], value: str, offsets: list[tuple[int, int]], of: Callable[[Column], Column]) -> DataFrame:
    """of(array) over the neighbours at offsets, for each pixel there is; absent neighbours are null elements. Values must not be null."""
    k = len(offsets)

    def listed(near: np.ndarray, there: np.ndarray) -> pa.Array:
        each = pa.array(near.T.reshape(-1), mask=~there.T.reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), each)

    found = windows(pixels, keys, value, offsets, listed, ArrayType(pixels.schema[value].dataType))
    return found.withColumn(value, of(F.col(value)))


def opened(pixels: DataFrame, keys: list[str], value: str, r: int) -> DataFrame:
    """Erosion and then dilation by the square of radius r."""
    return focal_dense(focal_dense(pixels, keys, value, r, "min"), keys, value, r, "max")


def closed(pixels: DataFrame, keys: list[str], value: str, r: int) -> DataFrame:
    return focal_dense(focal_dense(pixels, keys, value, r, "max"), keys, value, r, "min")


def median(pixels: DataFrame, keys: list[str], value: str, r: int) -> DataFrame:
    """Median over the square of radius r; missing neighbours count as zero."""
    offsets = box(r)
    middle = len(offsets) // 2
    values = pixels.withColumn(value, F.col(value).cast("double"))

    def of(near: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(np.partition(np.where(there, near, 0.0), middle, axis=0)[middle])

    return windows(values, keys, value, offsets, of, DoubleType())


def border_mode_fill(pixels: DataFrame, keys: list[str], value: str, hole: int = 255, r: int = 2) -> DataFrame:
    """Holes replaced by the most frequent value of the ring around all of an image's holes.

    The smallest of equals; null where the ring is empty. filled tells what was used.
    """
    near = focal_dense(pixels.withColumn("__hole", F.when(F.col(value) == hole, 1).otherwise(0)), keys, "__hole", r, "max")
    ring = near.where((F.col("__hole") == 1) & (F.col(value) != hole)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    mode = ring.groupBy(*keys).agg(F.max_by(value, F.struct("__n", -F.col(value))).alias("filled"))
    return with_groups(pixels, mode, keys, "left").withColumn(value, F.when(F.col(value) == hole, F.col("filled")).otherwise(F.col(value)))


def boundaries(pixels: DataFrame, keys: list[str], mask: str, name: str, r0: int = 1, r: int = 2) -> DataFrame:
    """name and name_ext: the inner boundary of a 0/1 (or soft) mask and that boundary widened, on dense images."""
    inverse = pixels.withColumn(name, 1 - F.col(mask))
    pooled = focal_dense(inverse, keys, name, r0, "max").withColumn(name, F.col(name) - (1 - F.col(mask)))
    return focal_dense(pooled.withColumn(f"{name}_ext", F.col(name)), keys, f"{name}_ext", r, "max")


def boundary_sums(pixels: DataFrame, keys: list[str], gt: str, pred: str, classes: list[int], r0: int = 1, r: int = 2, ignore: int = -1) -> DataFrame:
    """(keys, class, tp, tpfp, tn, tnfn) of label images, for boundary_f1().

    The masks of all classes, true and predicted, are bits of one long, so they are widened together; of more
    than 31 classes each 31 have a long of their own.
    """
    if len(classes) > 31:
        parts = [boundary_sums(pixels, keys, gt, pred, classes[k : k + 31], r0, r, ignore) for k in range(0, len(classes), 31)]
        return functools.reduce(DataFrame.unionByName, parts)
    n = len(classes)
    bit = lambda c, shift: functools.reduce(lambda out, k: F.when(F.col(c) == classes[k], F.lit(1 << (k + shift)).cast("long")).otherwise(out), range(n), F.lit(0).cast("long"))
    every = F.lit((1 << 2 * n) - 1).cast("long")
    masks = pixels.withColumn("__own", bit(gt, 0).bitwiseOR(bit(pred, n)))
    pooled = focal_dense(masks.withColumn("__b", F.col("__own").bitwiseXOR(every)), keys, "__b", r0, "or").withColumn("__b", F.col("__b").bitwiseAND(F.col("__own")))
    seen = focal_dense(pooled.withColumn("__e", F.col("__b")), keys, "__e", r, "or").where(F.col(gt) != ignore)
    on = lambda c, k: F.shiftright(F.col(c), k).bitwiseAND(F.lit(1).cast("long"))
    sums = F.array(*[
        F.struct(
            F.lit(classes[k]).alias("class"), F.sum(on("__b", k + n) * on("__e", k)).alias("tp"), F.sum(on("__b", k + n)).alias("tpfp"),
            F.sum(on("__e", k + n) * on("__b", k)).alias("tn"), F.sum(on("__b", k)).alias("tnfn"),
        )
        for k in range(n)
    ])
    return seen.groupBy(*keys).agg(sums.alias("__sums")).select(*keys, F.inline("__sums"))


def soft_boundary_sums(pixels: DataFrame, keys: list[str], gt: str, probs: str, classes: list[int], r0: int = 1, r: int = 2, ignore: int = -1) -> DataFrame:
    """boundary_sums() of class probabilities (an array by class) against labels: the boundary loss before its F1.

    The masks of all classes, true and predicted, are one array that is widened as a whole.
    """
    n = len(classes)
    true = [F.when(F.col(gt) == k, 1.0).otherwise(0.0) for k in classes]
    masks = F.array(*true, *[F.get(probs, F.lit(k)).cast("double") for k in classes])
    inverse = pixels.select(*keys, "row", "col", gt, F.transform(masks, lambda v: 1 - v).alias("__m")).withColumn("__b", F.col("__m"))
    inner = focal_dense(inverse, keys, "__b", r0, "max").withColumn("__b", F.zip_with("__b", "__m", lambda v, m: v - m)).drop("__m")
    seen = focal_dense(inner.withColumn("__e", F.col("__b")), keys, "__e", r, "max").where(F.col(gt) != ignore)
    at = lambda c, k: F.get(c, F.lit(k))
    sums = F.array(*[
        F.struct(
            F.lit(c).alias("class"), F.sum(at("__b", n + k) * at("__e", k)).alias("tp"), F.sum(at("__b", n + k)).alias("tpfp"),
            F.sum(at("__e", n + k) * at("__b", k)).alias("tn"), F.sum(at("__b", k)).alias("tnfn"),
        )
        for k, c in enumerate(classes)
    ])
    return seen.groupBy(*keys).agg(sums.alias("__sums")).select(*keys, F.inline("__sums"))


def mosaic_first(tiles: DataFrame, cell: list[str], value: str, order: Column, nodata: int = 0) -> DataFrame:
    """The first value of each cell that is not nodata, by order; nodata where there is none."""
    v = F.col(value)
    return tiles.groupBy(*cell).agg(F.coalesce(F.min_by(v, F.when(v != nodata, order)), F.lit(nodata)).alias(value))


def mosaic_last(tiles: DataFrame, cell: list[str], value: str, order: Column) -> DataFrame:
    """The last value of each cell that is not null, by order."""
    v = F.col(value)
    return tiles.groupBy(*cell).agg(F.max_by(v, F.when(v.isNotNull(), order)).alias(value))


def clean_elevation(pixels: DataFrame, keys: list[str], value: str, nodata: float = -9000.0, top: float = 0.999) -> DataFrame:
    """No-data to zero, then held between 0 and the image's percentile top (interpolated); null keys are an image."""
    return _held_to_top(pixels.withColumn(value, F.when(F.col(value) <= nodata, 0.0).otherwise(F.col(value))), keys, value, top)


def _held_to_top(pixels: DataFrame, keys: list[str], value: str, top: float) -> DataFrame:
    """value at least 0, and then at most the image's percentile top of what it was."""
    ceiling = exact_percentile(pixels, keys, value, top, "__top")
    return with_groups(pixels, ceiling, keys).withColumn(value, F.least(F.greatest(F.col(value), F.lit(0.0)), F.col("__top"))).drop("__top")


def surface_height(pixels: DataFrame, keys: list[str], dsm: str, dem: str, name: str = "height", nodata: float = -9000.0, top: float = 0.999) -> DataFrame:
    """Difference of two elevations, whose no-data is zero first; a difference has no no-data, so its percentile is of all of them, however low."""
    zero = lambda c: F.when(F.col(c) <= nodata, 0.0).otherwise(F.col(c))
    return _held_to_top(pixels.withColumn(name, zero(dsm) - zero(dem)), keys, name, top)


def min_max_8bit(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """value stretched from its image's range to 0 to 255; null where the range is empty. Null keys are an image."""
    ends = pixels.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    return with_groups(pixels, ends, keys).withColumn(value, F.try_divide((F.col(value) - low) * 255.0, high - low)).drop("__low", "__high")


def nearest_splat(points: DataFrame, pixel: list[str], depth: Column, label: str) -> DataFrame:
    """(pixel, label): the label plus one of the nearest point of each pixel, as rendered; pixels without points have no row.

    filled_splat() gives those 0, and unrendered_to_sky() turns both back to labels.
    """
    return points.groupBy(*pixel).agg((F.min_by(label, depth) + 1).alias(label))


def filled_splat(splat: DataFrame, grid: DataFrame, pixel: list[str], label: str) -> DataFrame:
    """Every pixel of grid with its rendered label; 0 where nothing was rendered."""
    return grid.join(splat, pixel, "left").withColumn(label, F.coalesce(label, F.lit(0)))


def gt_offset(code: Column, prediction: bool = False) -> Column:
    """File code to class: less two, ignored below; predictions are held at class 0 instead."""
    return F.greatest(code.cast("int") - 2, F.lit(0 if prediction else -1))


def unrendered_to_sky(mask: Column) -> Column:
    """Rendered labels less one; 0, where nothing was rendered, to 255."""
    return F.when(mask == 0, F.lit(255)).otherwise(mask - 1)


def out_of_domain(label: Column, last: int) -> Column:
    return F.greatest(F.when(label > last, F.lit(-1)).otherwise(label), F.lit(-1))


def ignored_to_first(pred: Column, ignore: int = -1) -> Column:
    """An ignored prediction has no one-hot entry, whose argmax is class 0."""
    return F.when(pred == ignore, F.lit(0)).otherwise(pred)


def feature_stack(optional: dict[str, Column]) -> Column:
    """Bands in fixed order: colour, near infrared, vegetation index, then one elevation (dem_1m, dem, dsm or height)."""
    parts = [optional[k] for k in ("rgb", "nir", "ndvi") if k in optional]
    elevation = next((optional[k] for k in ("dem_1m", "dem", "dsm", "height") if k in optional), None)
    return F.concat(*parts, *([elevation] if elevation is not None else []))


def rotated_half_turn(row: Column, col: Column, height: int, width: int) -> tuple[Column, Column]:
    return F.lit(height - 1) - row, F.lit(width - 1) - col


def nearest_index(i: Column, old: int, new: int) -> Column:
    """Source index of a nearest resize from old to new cells."""
    return F.least(F.floor(i * F.lit(old / new)).cast("int"), F.lit(old - 1))


def cropped(pixels: DataFrame, row: tuple[int, int], col: tuple[int, int]) -> DataFrame:
    """Rows and columns in half-open ranges, counted from the crop's corner."""
    inside = (F.col("row") >= row[0]) & (F.col("row") < row[1]) & (F.col("col") >= col[0]) & (F.col("col") < col[1])
    return pixels.where(inside).withColumn("row", F.col("row") - row[0]).withColumn("col", F.col("col") - col[0])


# Overlapping tiles


def tile_starts(size: int, tile: int, step: int | None = None) -> list[int]:
    """Starts of training tiles: every step, and one snapped to the end, repeated if it is there already."""
    step = step or tile - tile // 4
    return [*range(0, size - tile + 1, step), size - tile] if size >= tile else []


def tiled(pixels: DataFrame, height: int, width: int, tile: int, step: int | None = None) -> DataFrame:
    """pixels with tile_no and the tile's row and column, once for each tile that holds them.

    Each pixel finds its tiles by arithmetic, however many tiles there are.
    """
    step = step or tile - tile // 4

    def held(at: str, size: int) -> Column:
        """Array of (number, start) of the tiles over a row or column."""
        regular = len(range(0, size - tile + 1, step))
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - (tile - 1)) / step)).cast("int")
        high = F.least(F.lit(regular - 1), F.floor(F.col(at) / step)).cast("int")
        some = F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), (k * step).alias("start")))
        last = F.array(F.struct(F.lit(regular).alias("k"), F.lit(size - tile).alias("start")))
        none = F.slice(last, 1, 0)
        return F.concat(F.when(low <= high, some).otherwise(none), F.when((F.col(at) >= size - tile) & (F.col(at) < size), last).otherwise(none))

    if height < tile or width < tile:
        return pixels.where(F.lit(False)).select("*", *[F.lit(0).alias(c) for c in ("tile_no", "tile_row", "tile_col")])
    across = len(tile_starts(width, tile, step))
    each = pixels.select("*", F.explode(held("row", height)).alias("__r")).select("*", F.explode(held("col", width)).alias("__c"))
    return each.select(
        *pixels.columns, (F.col("__r.k") * across + F.col("__c.k")).alias("tile_no"),
        (F.col("row") - F.col("__r.start")).alias("tile_row"), (F.col("col") - F.col("__c.start")).alias("tile_col"),
    )


def dense_tiles(pixels: DataFrame, keys: list[str], value: str, height: int, width: int, absent: float = 0.0, name: str = "data") -> DataFrame:
    """(keys, name): each image as one array of doubles, row by row; absent and null pixels have a value of their own."""
    cells = pixels.select(*keys, (F.col("row") * width + F.col("col")).cast("int").alias("__k"), F.coalesce(F.col(value).cast("double"), F.lit(absent)).alias("__v"))
    schema = StructType([*[cells.schema[c] for c in keys], StructField(name, ArrayType(DoubleType()))])

    def one(t: pa.Table) -> pa.Table:
        data = np.full(height * width, absent)
        data[t["__k"].to_numpy()] = t["__v"].to_numpy()
        return t.slice(0, 1).select(keys).append_column(name, pa.ListArray.from_arrays(pa.array([0, len(data)], pa.int32()), pa.array(data)))

    return cells.groupBy(*keys).applyInArrow(one, schema)


def blend_count(size: int, patch: int, stride: int) -> int:
    return -(-(size - patch) // stride) + 1 if size > patch else 1


def in_patches(pixels: DataFrame, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """pixels with the patch (pr, pc) and the place in it (i, j), once for each patch; sums over a patch need no all-pairs join."""
    def firsts(at: str, n: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil((F.col(at) - (patch - 1)) / stride)).cast("int")
        high = F.least(F.lit(n - 1), F.floor(F.col(at) / stride)).cast("int")
        return F.explode(F.sequence(low, high))

    rows, cols = blend_count(height, patch, stride), blend_count(width, patch, stride)
    return (
        pixels.select("*", firsts("row", rows).alias("pr")).select("*", firsts("col", cols).alias("pc"))
        .withColumn("i", F.col("row") - F.col("pr") * stride).withColumn("j", F.col("col") - F.col("pc") * stride)
    )


def mirrored(pixels: DataFrame, height: int, width: int, patch: int, stride: int) -> DataFrame:
    """pixels, and beyond the lower and right edge as many mirrored ones as fill the last patches.

    blended() over their patches says something of the added ones too; cropped() takes the image back out.
    """
    rows, cols = blend_count(height, patch, stride), blend_count(width, patch, stride)

    def images_of(at: str, size: int, count: int) -> Column:
        over = (count - 1) * stride + patch - size
        twin = F.lit(2 * size - 1) - F.col(at)
        return F.explode(F.when(F.col(at) >= size - over, F.array(F.col(at), twin)).otherwise(F.array(F.col(at))))

    return pixels.withColumn("row", images_of("row", height, rows)).withColumn("col", images_of("col", width, cols))


def taper(i: Column, j: Column, patch: int, stride: int) -> Column:
    """Weight of a place in a patch: falls linearly over the overlap towards each side."""
    overlap = patch - stride
    d = 1 / (1 + overlap)
    ramp = lambda past: F.when(past >= 0, 1 - (past + 1) * F.lit(d)).otherwise(F.lit(1.0))
    one = lambda x: ramp(x - stride) * ramp(F.lit(patch - 1) - x - stride)
    return one(i) * one(j)


def blended(patched: DataFrame, keys: list[str], value: str, patch: int, stride: int) -> DataFrame:
    """Weighted mean over patches of what each says about a pixel."""
    w = taper(F.col("i"), F.col("j"), patch, stride)
    return patched.groupBy(*keys, "row", "col").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))


def standardised_probabilities(bands: Column) -> Column:
    """Bands as doubles that sum to one."""
    return arrays.softmax(arrays.doubles(bands))
