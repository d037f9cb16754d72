"""Connected regions of equal label on pixel tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .raster import opened
from .tables import materialised, numbered, shared_folder
from .whole import beside, codes, least_reached, sorted_places, with_whole_groups

#: Rows and columns of a block that one task labels; and cells of boxes that are held at once where whole images are split.
BLOCK, CELLS = 64, 1 << 21


def _contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v): v the least node reachable from u by edges (u, v), for every node that isn't its own least.

    Alternating stars: larger neighbours of a node go to its least one, then smaller ones do.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        least = pairs.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = pairs.join(least, [*keys, "u"])
        if larger:
            out = joined.where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
        return out.where("u <> v").distinct().checkpoint()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())

    edges = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        edges = star(star(both, True), False)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges


def regions(pixels: DataFrame, keys: list[str], label: str, height: int, width: int, diagonal: str | None = None) -> DataFrame:
    """pixels with region: the smallest row * width + col of its 4-connected region of equal label.

    Pixels where the column diagonal is true are joined over corners too. Blocks are labelled by themselves; then only regions that meet over a block's border are joined, by
    contraction, and the narrow result is joined back. keys and labels must not be null.
    """
    shared_folder(pixels.sparkSession)  # sets a folder for checkpoints where none is set
    cells = pixels.select(
        *keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(label).alias("label"), (F.col(diagonal) if diagonal else F.lit(False)).alias("__d")
    )
    block = [F.floor(F.col("row") / BLOCK).alias("__br"), F.floor(F.col("col") / BLOCK).alias("__bc")]
    own = [*keys, "row", "col", "label", "__d"]
    schema = StructType([*[cells.schema[c] for c in own], StructField("region", LongType())])

    def several(t: pa.Table, of: np.ndarray) -> pa.Table:
        row, col = t["row"].to_numpy(), t["col"].to_numpy()
        order, at, across = sorted_places(of, row, col)
        code, over = codes(t["label"])[0][order], t["__d"].to_numpy()[order]
        pairs = []
        for step in (1, across, across + 1, across - 1) if over.any() else (1, across):
            a, b = beside(at, step)
            met = code[a] == code[b]
            met = met & over[a] & over[b] if abs(step - across) == 1 else met
            pairs.append((a[met], b[met]))
        least = order[least_reached(len(at), *(np.concatenate(x) for x in zip(*pairs)))]
        region = np.empty(len(at), np.int64)
        region[order] = row[least].astype(np.int64) * width + col[least]
        return t.select(own).append_column("region", pa.array(region))

    local = with_whole_groups(cells.select("*", *block), [*keys, "__br", "__bc"], several, schema)
    if max(height, width) <= BLOCK:
        return local.select(*keys, "row", "col", F.col("label").alias(label), "region")
    local = local.checkpoint()
    first = lambda c, d: local.where(F.col(c) % BLOCK == BLOCK - 1).select(*keys, "row", "col", "label", F.col("region").alias("u")).withColumn(c, F.col(c) + d)
    other = local.where((F.col("row") % BLOCK == 0) | (F.col("col") % BLOCK == 0)).select(*keys, "row", "col", "label", F.col("region").alias("v"))
    met = first("row", 1).unionByName(first("col", 1)).join(other, [*keys, "row", "col", "label"]).select(*keys, "u", "v")
    if diagonal:
        # Over corners: a pixel at a block's lower or right border, or at its left one for the block to the lower left.
        rim = (F.col("row") % BLOCK == BLOCK - 1) | (F.col("col") % BLOCK == BLOCK - 1) | (F.col("col") % BLOCK == 0)
        below = F.inline(F.array(*[F.struct((F.col("row") + 1).alias("__r"), (F.col("col") + d).alias("__c")) for d in (-1, 1)]))
        ends = local.where(rim & F.col("__d")).select(*keys, "label", F.col("region").alias("u"), below).withColumnsRenamed({"__r": "row", "__c": "col"})
        met = met.unionByName(ends.join(local.where("__d").select(*keys, "row", "col", "label", F.col("region").alias("v")), [*keys, "row", "col", "label"]).where("u <> v").select(*keys, "u", "v"))
    joined = _contracted(met, keys).select(*keys, F.col("u").alias("region"), F.col("v").alias("__least"))
    return local.join(joined, [*keys, "region"], "left").select(
        *keys, "row", "col", F.col("label").alias(label), F.coalesce("__least", "region").alias("region")
    )


def _whole_split(image: np.ndarray, row: np.ndarray, col: np.ndarray, label: np.ndarray, height: int, width: int, at_once: int) -> np.ndarray:
    """The segment of each pixel of several images, as split_segments() has it; boxes are looked at a few at a time, in order."""
    place = lambda image, row, col: (image * height + row) * width + col
    pixels = place(image, row.astype(np.int64), col.astype(np.int64))
    order = np.argsort(pixels, kind="stable")
    at, labels = pixels[order], label[order]
    # Boxes in order of image and segment.
    kinds = int(label.max()) + 1
    boxes, of = np.unique(image * kinds + label, return_inverse=True)
    ends = []
    for v, size in ((row, height), (col, width)):
        low, high = np.full(len(boxes), size), np.full(len(boxes), -1)
        np.minimum.at(low, of, v)
        np.maximum.at(high, of, v)
        ends += [np.maximum(low - 1, 0), np.minimum(high + 1, size - 1)]
    r0, r1, c0, c1 = ends
    area = (r1 - r0 + 1) * (c1 - c0 + 1)
    out, numbers = np.full(len(row), -1), np.zeros(int(image.max()) + 1, np.int64)
    chunk = (np.cumsum(area) - area) // at_once
    for first, after in zip(np.searchsorted(chunk, np.unique(chunk)), [*np.searchsorted(chunk, np.unique(chunk))[1:], len(boxes)]):
        box = np.repeat(np.arange(first, after), area[first:after])
        k = np.arange(len(box)) - np.repeat(np.cumsum(area[first:after]) - area[first:after], area[first:after])
        i, j = r0[box] + k // (c1 - c0 + 1)[box], c0[box] + k % (c1 - c0 + 1)[box]
        pixel = place(boxes[box] // kinds, i, j)
        found = np.minimum(np.searchsorted(at, pixel), len(at) - 1)
        there = at[found] == pixel
        on = there & (labels[found] == boxes[box] % kinds)
        rim = (i == r0[box]) | (i == r1[box]) | (j == c0[box]) | (j == c1[box])
        _, held, across = sorted_places(box - first, i, j)  # cells are in this order
        pairs = []
        for step in (1, across, across + 1, across - 1):
            a, b = beside(held, step)
            met = on[a] & on[b] if abs(step - across) == 1 else on[a] == on[b]
            pairs.append((a[met], b[met]))
        region = least_reached(len(box), *(np.concatenate(x) for x in zip(*pairs)))
        outside = np.zeros(len(box), bool)
        outside[region[rim]] = True
        drawn = np.flatnonzero((region == np.arange(len(box))) & (on | ~outside))
        drawn = drawn[np.lexsort((drawn, ~on[drawn], box[drawn]))]
        # Numbered from 0 in each image, on from the boxes before.
        owner = boxes[box[drawn]] // kinds
        each = np.bincount(owner, minlength=len(numbers))
        number = np.full(len(box), -1)
        number[drawn] = np.arange(len(drawn)) - (np.cumsum(each) - each)[owner] + numbers[owner]
        numbers += each
        number = number[region]
        shown = there & (number >= 0)
        out[found[shown]] = number[shown]  # of those at one pixel the last stays, which is that of the last segment
    return out[np.searchsorted(at, pixels)]


def split_segments(pixels: DataFrame, keys: list[str], label: str, height: int, width: int, opening: int = 0) -> DataFrame:
    """(keys, row, col, segment): pixels' segments split to connected parts and filled holes, numbered from 0 in each image.

    Parts of a segment are its 8-connected regions; its holes are what they surround: 4-connected regions of all other
    pixels that don't reach the image's border. Both have numbers, by segment, parts before holes, by first pixel. Segments are
    drawn in order, each hole over what it is in, so a pixel has the number of the last segment that holds it
    or surrounds it. With opening, segments are first eroded and widened by squares of that radius, and
    pixels that nothing holds then have -1. Only a segment's own box, one pixel wider, is looked at. Absent pixels belong to no segment.
    Images no larger than a block of regions() are held as a whole by a task, many at a time.
    """
    if keys and not opening and max(height, width) <= BLOCK:
        px = pixels.select(*keys, "row", "col", F.col(label).alias("__l"))
        cells_at_once = CELLS

        def several(t: pa.Table, image: np.ndarray) -> pa.Table:
            code, values = codes(t["__l"])
            rank = np.argsort(pc.array_sort_indices(values).to_numpy())
            found = _whole_split(image, t["row"].to_numpy(), t["col"].to_numpy(), rank[code], height, width, cells_at_once)
            return t.select([*keys, "row", "col"]).append_column("segment", pa.array(found))

        schema = StructType([*[px.schema[c] for c in (*keys, "row", "col")], StructField("segment", LongType())])
        return with_whole_groups(px, keys, several, schema)
    boxes = pixels.groupBy(*keys, F.col(label).alias("__s")).agg(
        F.greatest(F.min("row") - 1, F.lit(0)).alias("r0"), F.least(F.max("row") + 1, F.lit(height - 1)).alias("r1"),
        F.greatest(F.min("col") - 1, F.lit(0)).alias("c0"), F.least(F.max("col") + 1, F.lit(width - 1)).alias("c1"),
    )
    boxed = boxes.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    rim = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    named = pixels.select(*keys, "row", "col", F.col(label).alias("__l"))
    cells = boxed.join(named, [*keys, "row", "col"], "left").select(
        *keys, "__s", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), rim.alias("__rim"), F.coalesce(F.col("__l") == F.col("__s"), F.lit(False)).cast("int").alias("__on")
    )
    own = [*keys, "__s"]
    if opening:
        cells = opened(cells, own, "__on", opening)
    cells = materialised(cells.withColumn("__d", F.col("__on") == 1))
    found = regions(cells, own, "__on", height, width, "__d").join(cells.select(*own, "row", "col", "__rim"), [*own, "row", "col"])
    found = materialised(found)
    drawn = found.groupBy(*own, "__on", "region").agg(F.max("__rim").alias("__rim")).where("__on = 1 OR NOT __rim").withColumn("__hole", 1 - F.col("__on"))
    ids = numbered(drawn.select(*own, "__on", "region", "__hole"), keys, ["__s", "__hole", "region"], "segment")
    last = found.join(ids.drop("__hole"), [*own, "__on", "region"]).groupBy(*keys, "row", "col").agg(F.max_by("segment", "__s").alias("segment"))
    return pixels.select(*keys, "row", "col").join(last, [*keys, "row", "col"], "left").withColumn("segment", F.coalesce("segment", F.lit(-1).cast("long")))
