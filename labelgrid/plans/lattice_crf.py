"""Dense CRF over images of any size: Gaussian filters on a permutohedral lattice.

A pixel's features place it in a simplex of the lattice of d + 1 corners. Blocks of pixels add their values up at the corners;
the points of all blocks go to the cells of the lattice that they are in or near, are blurred there along each of the d + 1 axes,
and go back to the blocks that asked. So what moves is a block's points and not its pixels' corners, work and rows
grow with pixels and not with their pairs, and no image or tile is held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..operators.tables import materialised
from ..operators.whole import with_whole_groups

#: Rows and columns of a block of pixels; and how far a cell of a lattice of d dimensions goes along each coordinate, by d.
#: A blur reaches 2 d, so of many dimensions a cell has to be wide for few of its neighbours' points to come too.
BLOCK, CELL = 128, 48


def corners(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, d + 1, d) places of the corners around features (n, d) of unit width, and (n, d + 1) barycentric weights.

    Of the d + 1 coordinates of a lattice point, which sum to zero, the first d are given.
    """
    n, d = features.shape
    axes = np.arange(1, d + 1)
    # A Gaussian of unit width, blurred by (1/4, 1/2, 1/4) along each axis, is this many lattice steps wide.
    f = features * ((d + 1) * math.sqrt(2 / 3) / np.sqrt(axes * (axes + 1)))
    after = np.concatenate([np.cumsum(f[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1))], axis=1)
    high = after - np.concatenate([np.zeros((n, 1)), axes * f], axis=1)
    # The nearest point whose coordinates are multiples of d + 1, put back on the plane by those that were rounded most.
    whole = np.round(high / (d + 1)).astype(np.int64)
    rest = high - whole * (d + 1)
    rank = np.empty((n, d + 1), np.int64)
    np.put_along_axis(rank, np.argsort(-rest, axis=1, kind="stable"), np.arange(d + 1)[None], axis=1)
    rank += whole.sum(axis=1, keepdims=True)
    low, top = rank < 0, rank > d
    whole += low.astype(np.int64) - top
    rank += (d + 1) * (low.astype(np.int64) - top)
    share = (high - whole * (d + 1)) / (d + 1)
    by_rank = np.take_along_axis(share, np.argsort(rank, axis=1), axis=1)
    weights = np.empty((n, d + 1))
    weights[:, 1:] = (by_rank[:, :-1] - by_rank[:, 1:])[:, ::-1]
    weights[:, 0] = 1 - weights[:, 1:].sum(axis=1)
    step = np.arange(d + 1)[None, :, None]
    places = (whole * (d + 1))[:, None, :d] + step - (d + 1) * (rank[:, None, :d] > d - step)
    return places, weights


def _numbers(places: np.ndarray, low: np.ndarray, side: int) -> np.ndarray:
    """A number for each of places (n, d), whose coordinates are low and up to side - 1 more: sums of powers, so a step adds the same everywhere.

    Beyond 64 bits, that is for very many features, the odd side's powers make hashes of them.
    """
    return (places - low).astype(np.uint64) @ _powers(places.shape[1], side)


def _powers(d: int, side: int) -> np.ndarray:
    return np.array([pow(side, i, 1 << 64) for i in range(d)], np.uint64)


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(of, values[:, k], n) for k in range(values.shape[1])], axis=1)


def splat(places: np.ndarray, weights: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lattice points (m, d) at the corners of pixels, and what values (n, k) add up to there."""
    flat = places.reshape(-1, places.shape[2])
    low = flat.min(axis=0)
    _, first, of = np.unique(_numbers(flat, low, int((flat.max(axis=0) - low).max()) + 1 | 1), return_index=True, return_inverse=True)
    each = (weights[:, :, None] * values[:, None]).reshape(-1, values.shape[1])
    return flat[first], _sums(of, each, len(first))


def sliced(places: np.ndarray, weights: np.ndarray, points: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What pixels read at their corners of the values (m, k) of points."""
    flat = places.reshape(-1, places.shape[2])
    low = flat.min(axis=0)
    side = int((flat.max(axis=0) - low).max()) + 1 | 1
    asked, there = _numbers(flat, low, side), _numbers(points, low, side)
    order = np.argsort(there)
    found = values[order[np.searchsorted(there, asked, sorter=order)]]
    return (weights[:, :, None] * found.reshape(*weights.shape, -1)).sum(axis=1) / (1 + 2.0 ** -places.shape[2])


def in_cells(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, index): the cells, so wide, that points are in, or so near that a blur brings their values there."""
    d = points.shape[1]
    index, cells = np.arange(len(points)), points // size
    for c in range(d):  # each axis moves a coordinate by one, and one axis by d
        parts = [(index, cells)]
        for near in (-2 * d, 2 * d):
            other = (points[index, c] + near) // size
            over = other != cells[:, c]
            moved = cells[over].copy()
            moved[:, c] = other[over]
            parts.append((index[over], moved))
        index, cells = (np.concatenate(x) for x in zip(*parts))
    return cells, index


def blurred(points: np.ndarray, values: np.ndarray, cell: np.ndarray, size: int) -> np.ndarray:
    """Values (n, k) added up where points are the same, and blurred along each axis between the points there are.

    Right for the points of the cell, if all points near it are given.
    """
    d = points.shape[1]
    side = size + 6 * d + 1 | 1  # a step from the outermost points stays inside
    there, of = np.unique(_numbers(points, cell * size - 3 * d, side), return_inverse=True)
    out = _sums(of, values, len(there))
    for axis in range(d + 1):
        step = np.where(np.arange(d) == axis, -d, 1).astype(np.int64).astype(np.uint64) @ _powers(d, side)
        found = np.minimum(np.searchsorted(there, there + step), len(there) - 1)
        a = np.flatnonzero(there[found] == there + step)
        b = found[a]
        half = out / 2
        out[a] += half[b]
        out[b] += half[a]
    return out[of]


def _flat(column: pa.ChunkedArray, width: int = 1) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *[a.size for a in arrays]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.reshape(-1) for a in arrays]) if arrays else [], kind))


class Lattices:
    """Two lattices over blocks of pixels: near, of places alone, and wide, of places and features.

    A block is a row (keys, __br, __bc, …) with arrays of its pixels' row, col and f: their third places and features, one after the other.
    """

    def __init__(self, keys: list[str], widths: tuple[list[float], list[float]], features: int):
        self.keys, self.widths, self.features = keys, [np.array(w, float) for w in widths], features
        self.block = [*keys, "__br", "__bc"]

    def corners(self, block: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
        own = [_flat(block["f"], self.features)] if self.features else []
        w = self.widths[kind]
        return corners(np.column_stack([_flat(block["row"]), _flat(block["col"]), *own])[:, : len(w)] / w)

    def filtered(self, blocks: DataFrame, values, k: int, of, schema: StructType) -> DataFrame:
        """Of each block of(block, near, wide): values(block, kind) (n, k) of all pixels, summed by their Gaussian nearness on either lattice.

        What of() returns are the columns of schema after the block's.
        """
        numbers, doubles, cell_size = ArrayType(IntegerType()), ArrayType(DoubleType()), CELL
        own = [blocks.schema[c] for c in self.block]
        sent_as = StructType([*own, StructField("__kind", IntegerType()), StructField("__cell", numbers), StructField("place", numbers), StructField("v", doubles)])
        back_as = StructType([*own, StructField("__kind", IntegerType()), StructField("place", numbers), StructField("v", doubles)])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    block = pa.Table.from_batches([batch.slice(i, 1)])
                    for kind in (0, 1):
                        points, sums = splat(*self.corners(block, kind), values(block, kind))
                        cells, index = in_cells(points, cell_size * points.shape[1])
                        names, to = np.unique(cells, axis=0, return_inverse=True)
                        groups = np.split(index[np.argsort(to, kind="stable")], np.cumsum(np.bincount(to, minlength=len(names)))[:-1])
                        rows = block.select(self.block).take(pa.array(np.zeros(len(names), int)))
                        for name, column in (
                            ("__kind", pa.array(np.full(len(names), kind), pa.int32())), ("__cell", _listed(list(names), pa.int32())),
                            ("place", _listed([points[g] for g in groups], pa.int32())), ("v", _listed([sums[g] for g in groups], pa.float64())),
                        ):
                            rows = rows.append_column(name, column)
                        yield from rows.combine_chunks().to_batches()

        def blur(t: pa.Table) -> pa.Table:
            cell, kind = np.array(t["__cell"][0].as_py()), t["__kind"][0].as_py()
            d = len(self.widths[kind])
            points = _flat(t["place"], d).astype(np.int64)
            out = blurred(points, _flat(t["v"], k), cell, cell_size * d)
            mine = (points // (cell_size * d) == cell).all(axis=1)
            of_row = np.repeat(np.arange(t.num_rows), t["place"].combine_chunks().value_lengths().to_numpy() // d)[mine]
            ends = np.cumsum(np.bincount(of_row, minlength=t.num_rows))[:-1]
            rows = t.select([*self.block, "__kind"]).append_column("place", _listed(np.split(points[mine], ends), pa.int32()))
            rows = rows.append_column("v", _listed(np.split(out[mine], ends), pa.float64()))
            return rows.filter(pa.array(np.bincount(of_row, minlength=t.num_rows) > 0))

        def read(block: pa.Table, said: pa.Table) -> pa.Table:
            kinds = said["__kind"].to_numpy()
            found = []
            for kind in (0, 1):
                part = said.filter(pa.array(kinds == kind))
                found.append(sliced(*self.corners(block, kind), _flat(part["place"], len(self.widths[kind])).astype(np.int64), _flat(part["v"], k)))
            made, out = of(block, *found), block.select(self.block)
            for field in schema.fields[len(own) :]:
                v = made[field.name]
                out = out.append_column(field.name, v if isinstance(v, pa.ChunkedArray) else _listed([v], pa.float64()))
            return out

        back = blocks.mapInArrow(send, sent_as).groupBy(*self.keys, "__kind", "__cell").applyInArrow(blur, back_as)
        # Shares q have been sent; who reads what came back needs them no more.
        return materialised(blocks.drop("q").groupBy(*self.block).cogroup(back.groupBy(*self.block)).applyInArrow(read, schema))


def refined_on_lattice(
    pixels: DataFrame, keys: list[str], classes: int, alpha: float = 20.0, betas: list[float] | float = 5.0, gamma: float = 3.0, weights: tuple[float, float] = (3.0, 5.0),
    steps: int = 5, depth: str | None = None, depth_widths: tuple[float, float] | None = None, normalise: bool = True,
) -> DataFrame:
    """(keys, row, col, label, prob, classes) of pixels (keys, row, col, probs, features): mean field with a Gaussian on places and one on places and features.

    alpha and gamma are the widths of places in the second and the first; betas is a width for all features or a
    list with one for each; depth names a column that is a third place, of the widths depth_widths (with alpha, with gamma).
    Labels that differ cost one. Kernels are normalised symmetrically, or not at all. A pixel's own value is part of its sums.
    """
    # A block is a long row: of those, few are handed to Python at once.
    pixels.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    first = None if isinstance(betas, list) else pixels.select("features").first()
    betas = betas if isinstance(betas, list) else [float(betas)] * (len(first[0]) if first else 0)
    thirds = [F.col(depth).cast("double")] if depth else []
    z = list(depth_widths) if depth else []
    numbers = lambda c: F.transform(c, lambda v: v.cast("double"))
    cost = [-F.log(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("probs", F.lit(k)).cast("double"))) + 1e-3) for k in range(classes)]
    flat = pixels.select(
        *keys, "row", "col", F.concat(F.array(*thirds).cast("array<double>"), numbers(F.slice("features", 1, len(betas)))).alias("f"), F.array(*cost).alias("u"),
        F.floor(F.col("row") / BLOCK).alias("__br"), F.floor(F.col("col") / BLOCK).alias("__bc"),
    )
    lattices = Lattices(keys, ([gamma, gamma, *z[1:]], [alpha, alpha, *z[:1], *betas]), len(thirds) + len(betas))
    doubles = ArrayType(DoubleType())
    own = [flat.schema[c] for c in lattices.block]
    listed = [StructField(c, ArrayType(flat.schema[c].dataType)) for c in ("row", "col")]
    packed_as = StructType([*own, *listed, StructField("f", doubles), StructField("u", doubles)])

    def pack(t: pa.Table, group: np.ndarray) -> pa.Table:
        heads = np.concatenate([np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]])
        out = t.select(lattices.block).take(pa.array(heads[:-1]))
        for c, n in (("row", 1), ("col", 1), ("f", lattices.features), ("u", classes)):
            held = t[c].combine_chunks()
            out = out.append_column(c, pa.ListArray.from_arrays(pa.array((heads * n).astype(np.int32)), held if n == 1 and c in ("row", "col") else held.flatten()))
        return out

    def softmax(energies: np.ndarray) -> np.ndarray:
        raised = np.exp(energies - energies.max(axis=1, keepdims=True))
        return raised / raised.sum(axis=1, keepdims=True)

    blocks = materialised(with_whole_groups(flat, lattices.block, pack, packed_as))
    kept = ["row", "col", "f", "u"]
    if normalise:
        scaled_as = StructType([*packed_as.fields, StructField("s0", doubles), StructField("s1", doubles)])

        def scales(block: pa.Table, near: np.ndarray, wide: np.ndarray) -> dict:
            return {c: block[c] for c in kept} | {"s0": 1 / np.sqrt(near + 1e-20), "s1": 1 / np.sqrt(wide + 1e-20)}

        blocks = lattices.filtered(blocks, lambda block, kind: np.ones((len(_flat(block["row"])), 1)), 1, scales, scaled_as)
        kept += ["s0", "s1"]

    def shares(block: pa.Table) -> np.ndarray:
        return _flat(block["q"], classes) if "q" in block.column_names else softmax(-_flat(block["u"], classes))

    def scaled(block: pa.Table, kind: int, values: np.ndarray) -> np.ndarray:
        return values * _flat(block[f"s{kind}"]) if normalise else values

    def moved(block: pa.Table, near: np.ndarray, wide: np.ndarray) -> dict:
        energies = scaled(block, 0, near) * weights[0] + scaled(block, 1, wide) * weights[1] - _flat(block["u"], classes)
        return {c: block[c] for c in kept} | {"q": softmax(energies)}

    for k in range(steps):
        columns = kept if k < steps - 1 else ["row", "col"]
        as_ = StructType([*own, *[blocks.schema[c] for c in columns], StructField("q", doubles)])
        blocks = lattices.filtered(blocks, lambda block, kind: scaled(block, kind, shares(block)), classes, moved, as_)

    out_as = StructType([*[flat.schema[c] for c in (*keys, "row", "col")], StructField("label", IntegerType()), StructField("prob", DoubleType()), StructField("classes", doubles)])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            q = shares(t)
            n = t["row"].combine_chunks().value_lengths().to_numpy()
            of = pa.array(np.repeat(np.arange(len(n)), n))
            columns = {c: t[c].take(of) for c in keys} | {c: t[c].combine_chunks().flatten() for c in ("row", "col")}
            columns |= {"label": pa.array(q.argmax(axis=1), pa.int32()), "prob": pa.array(q.max(axis=1)), "classes": pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, classes, dtype=np.int32)), pa.array(q.reshape(-1)))}
            yield from pa.table(columns).to_batches()

    return blocks.mapInArrow(unpack, out_as)
