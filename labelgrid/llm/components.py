"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task contracts by itself.
PART = 1 << 19


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
    )


def _within_parts(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) from each node to the smallest of its component among a part's edges, PART edges at a time about."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        n = 0

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def stars(of: pa.DataType) -> pa.RecordBatch:
            found = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], of), pa.array([r for _, r in found], of)], ["u", "v"])

        of = None
        for batch in batches:
            of = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(up.setdefault(u, u)), root(up.setdefault(v, v))
                if a != b:
                    up[max(a, b)] = min(a, b)
            n += batch.num_rows
            if n > 2 * PART:
                yield stars(of)
                up.clear()
                n = 0
        if up:
            yield stars(of)

    return edges.coalesce(parts).mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Each round points the larger neighbours of every node at its smallest one, then the smaller
    ones, until nothing changes: about log2 of the largest component rounds. Before a round tasks contract
    the edges they hold, PART each; once all fit one part they are done. Neighbour minima are aggregated
    before they are joined back, and both sides of each join are written tables, so
    adaptive execution can split the join of a hub. Repeated edges and edges of a node with itself
    change nothing; nodes without an edge to another are not returned; nodes must not be null; no edges
    give no rows.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        """pairs (u, v), v a neighbour of u. Emits (v, m) for the neighbours concerned, m the least of all."""
        least = written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        joined = pairs.join(least, "u")
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return written(out.where("u <> v").distinct())

    edges = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    before = _state(edges)
    while before[0]:
        parts = -(-before[0] // PART)
        edges = written(_within_parts(edges, parts))
        if parts == 1:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # After the large star every edge runs from a node to a smaller one.
        edges = star(star(both, True), False)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
