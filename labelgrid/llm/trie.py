"""A binary trie of keys joined with itself within a budget of differing bits.

Spark spreads the trie in cells: of a key's bits, cut in one block more than the budget, a pair
within the budget has some block in common, so each key is copied once for each block, to the cell of
that block's value. What is left of the keys is the subtree under the cell. A cell of too many keys is
cut again by blocks of its remaining bits, at last by pairs of salted parts. Tasks go down the
subtrees of their cells; how often a key is copied does not depend on the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of a cell that one task takes at once.
CELL = 1 << 16
#: Bits of a subtree that are not cut to blocks any more.
LEAST_WIDTH = 16
#: Rows of whole cells that are walked together, and node pairs expanded at once; more wait on a stack.
ROWS = 1 << 15
BLOCK = 1 << 19


# Cells


def _by_blocks(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """rows (cell, rest, ...) once for each of parts blocks of the width bits of rest.

    The block's value goes from rest into the cell. Cells are hashes: should two fall together, the
    pairs of both are still all met, and the walk's own check tells strangers apart.
    """
    size = width // parts
    rest = F.col("rest")

    def cut(k: int) -> Column:
        low = width - (k + 1) * size
        block = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        above = F.shiftrightunsigned(rest, low + size) if k else F.lit(0).cast("long")
        below = rest.bitwiseAND(F.lit((1 << low) - 1).cast("long"))
        return F.struct(
            F.xxhash64("cell", F.lit(k), block).alias("cell"), F.shiftleft(above, low).bitwiseOR(below).alias("rest")
        )

    others = [c for c in rows.columns if c not in ("cell", "rest")]
    return rows.select(*others, F.inline(F.array(*map(cut, range(parts)))))


def _by_salt(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """rows of cells too large, each cell cut to parts by a hash of id; a cell for each pair of parts."""
    parts = F.ceil(F.col("n") / (most // 2)).cast("int")
    salted = rows.join(counts, "cell").withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int"))
    met = salted.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return met.select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *[c for c in rows.columns if c != "cell"]
    )


def in_cells(rows: DataFrame, width: int, budget: int, most: int | None = None) -> list[tuple[DataFrame, int]]:
    """(rows, width of rest) lists: rows (cell, rest, id, ...) spread over cells of at most about `most` rows.

    Two rows of one cell whose rest differs in budget bits at most share a cell afterwards too.
    """
    most, done = most or CELL, []
    while True:
        rows, width = _by_blocks(rows, width, budget + 1), width - width // (budget + 1)
        counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        hot = written(counts)
        if hot.isEmpty():
            return [*done, (rows, width)]
        done.append((rows.join(hot.select("cell"), "cell", "left_anti"), width))
        rows = rows.join(hot.select("cell"), "cell", "left_semi")
        if width <= LEAST_WIDTH:
            return [*done, (_by_salt(rows, hot, most), width)]


Rows = dict[str, np.ndarray]


def over_cells(rows: DataFrame, key: Callable[[Rows], np.ndarray], found: Callable[[Rows, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """found(columns, keys, bounds) over runs of whole cells: arrays of rows sorted by cell and key(columns)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        n = 0
        for batch in batches:
            held.append({c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(names)})
            n += batch.num_rows
            if n < ROWS:
                continue
            now = {c: np.concatenate([h[c] for h in held]) for c in names}
            cut = int(np.searchsorted(now["cell"], now["cell"][-1]))  # the last cell may go on
            if cut:
                yield from _in_order({c: v[:cut] for c, v in now.items()}, key, found)
            held, n = [{c: v[cut:] for c, v in now.items()}], n - cut
        if n:
            yield from _in_order({c: np.concatenate([h[c] for h in held]) for c in names}, key, found)

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, ddl)


def _in_order(rows: Rows, key, found) -> Iterator[pa.RecordBatch]:
    keys = key(rows)
    order = np.lexsort((keys, rows["cell"]))
    rows, keys = {c: v[order] for c, v in rows.items()}, keys[order]
    edges = np.flatnonzero(rows["cell"][1:] != rows["cell"][:-1]) + 1
    yield from found(rows, keys, np.concatenate([[0], edges, [len(order)]]))


# The walk


class Forest:
    """Union-find over 0..n-1 that keeps the links that joined something."""

    def __init__(self, n: int, labels: np.ndarray | None = None):
        self.up = list(range(n))
        if labels is not None:  # rows of one label are joined from the start, to the first of them
            _, first, of = np.unique(labels, return_index=True, return_inverse=True)
            self.up = first[of].tolist()
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.links.append((x, y))

    def labels(self) -> np.ndarray:
        return np.fromiter(map(self.root, range(len(self.up))), np.int64, len(self.up))


def _expanded(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of pairs of runs, at most about BLOCK at once; of a run with itself each pair once."""
    na, nb = (a1 - a0).astype(np.int64), (b1 - b0).astype(np.int64)
    at = 0
    while at < len(a0):
        end = at + max(1, int(np.searchsorted(np.cumsum(na[at:] * nb[at:]), BLOCK, "right")))
        lead, width, size = (x[at:end] for x in (a0, nb, na * nb))
        total = int(size.sum())
        for low in range(0, total, BLOCK):
            k = np.arange(low, min(total, low + BLOCK))
            owner = np.searchsorted(np.cumsum(size), k, "right")
            k = k - (np.cumsum(size) - size)[owner]
            i, j = lead[owner] + k // width[owner], b0[at:end][owner] + k % width[owner]
            keep = (i < j) | (a0[at:end] != b0[at:end])[owner]
            yield i[keep], j[keep]
        at = end


def walk(
    keys: np.ndarray, bounds: np.ndarray, levels: int, budgets: list[int], near, labels: np.ndarray | None = None, all_pairs: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell whose keys' first levels bits stay within budgets and that near() confirms.

    keys: uint64, sorted in each cell; bounds: where cells begin and end; budgets[d]: bits that may
    differ above depth d; near(i, j): a mask for arrays of rows. A trie node is a run of a cell's
    keys. Pairs of nodes go down together: each splits by its next bit, a pair of unlike bits costs
    one, and pairs over budget end there. Pairs of nodes of one component end too: of the pairs found
    so far, of which only those that join components are given, and of labels; with all_pairs of labels
    alone, and then all pairs between them are given.
    """
    forest = None if all_pairs else Forest(len(keys), labels)
    change = None if labels is None else np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
    ones: dict[int, np.ndarray] = {}
    linked = 0

    def ones_before(level: int) -> np.ndarray:
        if level not in ones:
            bit = (keys >> np.uint64(63 - level)) & np.uint64(1)
            ones[level] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))]).astype(np.int32)
        return ones[level]

    def confirmed(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if labels is not None:
            apart = labels[i] != labels[j]
            i, j = i[apart], j[apart]
        if not len(i):
            return
        ok = near(i, j)
        i, j = i[ok], j[ok]
        if all_pairs:
            yield i, j
        elif len(i):
            before = len(forest.links)
            forest.join(i, j)
            new = np.array(forest.links[before:], np.int64).reshape(-1, 2)
            yield new[:, 0], new[:, 1]

    start, stop = bounds[:-1], bounds[1:]
    many = stop - start > 1
    start, stop = start[many].astype(np.int32), stop[many].astype(np.int32)
    stack = [(0, start, stop, start, stop, np.zeros(len(start), np.int8))]
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > BLOCK:
            half = len(a0) // 2
            stack += [(level, a0[half:], a1[half:], b0[half:], b1[half:], err[half:]), (level, a0[:half], a1[:half], b0[:half], b1[:half], err[:half])]
            continue
        if forest is not None and len(forest.links) > linked + max(256, len(keys) >> 6):
            linked = len(forest.links)
            labels = forest.labels()
            change = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        if change is not None:
            joined = (labels[a0] == labels[b0]) & (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0])
            if joined.any():
                a0, a1, b0, b1, err = (x[~joined] for x in (a0, a1, b0, b1, err))
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            yield from confirmed(i[i != j], j[i != j])
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if level == levels:
            for i, j in _expanded(a0, a1, b0, b1):
                yield from confirmed(i, j)
            continue
        sums = ones_before(level)
        am, bm = a1 - (sums[a1] - sums[a0]), b1 - (sums[b1] - sums[b0])
        same = (a0 == b0) & (a1 == b1)
        parts = []
        for la, ra, lb, rb, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (ra > la) & (rb > lb) & (err + cost <= budgets[level + 1])
            if cost and lb is b0:
                keep &= ~same  # the mirror image of the pair before
            parts.append((la[keep], ra[keep], lb[keep], rb[keep], err[keep] + np.int8(cost)))
        merged = [np.concatenate(x) for x in zip(*parts)]
        if len(merged[0]):
            stack.append((level + 1, *merged))
