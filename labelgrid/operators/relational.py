"""Relational pieces of experiment reports."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import materialised


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Every row with its group's columns; groups has a row per key, and null keys are a group of their own."""
    if not keys:  # one group, of one row
        return rows.join(groups, F.lit(True), how)
    named = {k: f"__group_{i}" for i, k in enumerate(keys)}
    same = functools.reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(n)) for k, n in named.items()])
    return rows.join(groups.withColumnsRenamed(named), same, how).drop(*named.values())


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: list[Column]) -> DataFrame:
    """Inner join with the first right row of each key; left rows without one are left out."""
    columns = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first"))
    return left.join(first.select(*on, "__first.*"), on)


def listed_only(rows: DataFrame, allowed: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(allowed.select(*on).distinct(), on, "left_semi")


def aligned_or_error(left: DataFrame, right: DataFrame, on: list[str], partner: str) -> DataFrame:
    """Join in which a left row without a partner is an error when it is read."""
    joined = left.join(right, on, "left")
    checked = F.when(F.col(partner).isNull(), F.raise_error(F.lit(f"a row has no partner by {', '.join(on)}"))).otherwise(F.col(partner))
    return joined.withColumn(partner, checked)


def latched(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Every row with its group's value in the first row; the whole group shares that row's null or NaN.

    Rows whose keys are null are a group like any other.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(value), F.struct(*order))[value].alias(name))
    return with_groups(rows, first, keys)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows per group before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def duplicated(rows: DataFrame, when: Column, column: str, copy: str) -> DataFrame:
    """rows, and once more those for which when holds, with copy in column."""
    values = F.when(when, F.array(F.col(column), F.lit(copy))).otherwise(F.array(F.col(column)))
    return rows.withColumn("__v", F.explode(values)).drop(column).withColumnRenamed("__v", column)


def usable_pose(columns: dict[str, list[str]]) -> Column:
    """Name of the first group of columns with a null or NaN; null for usable rows."""
    out = F.lit(None).cast("string")
    for name, cols in reversed(columns.items()):
        bad = F.lit(False)
        for c in cols:
            bad = bad | F.col(c).isNull() | F.isnan(c)
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


def nan_to_null(rows: DataFrame) -> DataFrame:
    floats = {n for n, t in rows.dtypes if t in ("double", "float")}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def without_wide_jitter(rows: DataFrame, limit: float = 10.0) -> DataFrame:
    """Drops gps and altitude rows beyond limit; orientation rows and rows without a type stay."""
    wide = F.coalesce(F.col("jitter_type").isin("gps", "altitude") & (F.col("jitter") > limit), F.lit(False))
    return rows.where(~wide)


def pivoted(rows: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    """One row per index, one column per value; a cell with more than one row is an error."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("a pivot cell has more than one row")).cast("double")).otherwise(F.first(value))
    return rows.groupBy(*index).pivot(column, values).agg(one)


def in_category_order(rows: DataFrame, column: str, order: list[str], descending: bool = False) -> DataFrame:
    """Sorted by place in order; other values come last. descending turns the whole order round."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    place = F.when(at == 0, F.lit(len(order) + 1)).otherwise(at)
    return rows.orderBy(F.desc(place), F.desc(column)) if descending else rows.orderBy(place, column)


def counts_with_total(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key and, under a null key, in all; null keys are not counted."""
    return rows.where(F.col(key).isNotNull()).rollup(key).agg(F.count(F.lit(1)).alias("n"))


def intersection_bounds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))


def boxes_meet(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Whether boxes (x0, y0, x1, y1) touch."""
    return (F.col(a[0]) <= F.col(b[2])) & (F.col(b[0]) <= F.col(a[2])) & (F.col(a[1]) <= F.col(b[3])) & (F.col(b[1]) <= F.col(a[3]))


#: Bins along a side of a box; rows that share a place and are held as one; parts of size down to which bins get smaller.
_FINE, _HELD, _PARTS = 4, 4096, 20


def binned_box_join(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """points (x, y) with the boxes (x0, y0, x1, y1) that hold them, by bins instead of all pairs.

    Boxes have levels: size times a power of two for their width, and one for their height; bins are a quarter as wide and high. Of a
    level with fewer boxes than there are points, a box goes to the some 25 bins that it lies in and a point to its own; of any
    other, a box goes to the bin of its lower corner and a point to those that a box around it can begin in: so what moves grows with the fewer of
    both. Points at one place go together, up to 4,096 at a time. The rows are as many as points lie in boxes: if both tables
    grow, they grow with the product. Those of a place come box after box, which Parquet keeps in little room.
    """
    seen = points.agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max), ("far", lambda c: F.max(F.when(F.abs(c) < math.inf, F.abs(c)))))]
    ).first()
    meets = functools.reduce(lambda a, b: a & b, [(F.col(f"{c}1") >= F.lit(seen[f"least_{c}"])) & (F.col(f"{c}0") <= F.lit(seen[f"most_{c}"])) for c in "xy"])
    level = lambda lo, hi: F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(size / 2.0**_PARTS)) / size) - 1e-9).cast("int")
    sized = boxes.where("x0 <= x1 AND y0 <= y1").where(meets).withColumns({"__lx": level("x0", "x1"), "__ly": level("y0", "y1")})
    # One for each power of two of width and height that boxes have.
    levels = sized.groupBy("__lx", "__ly").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x1") - F.col("x0")).alias("wx"), F.max(F.col("y1") - F.col("y0")).alias("wy"))
    levels = sorted(tuple(r) for r in levels.collect() if None not in tuple(r))
    # Places have to be told apart well below a bin, for a point's bins to be few.
    told = lambda w, c, l: math.isfinite(w) and float(seen[f"far_{c}"] or 0) * 2.0**-50 <= 2.0**l * size / _FINE
    wide = {(a, b): (float(wx), float(wy)) for a, b, n, wx, wy in levels if n > seen["n"] and told(wx, "x", a) and told(wy, "y", b)}
    pair = lambda a, b, *w: F.struct(F.lit(a).alias("__lx"), F.lit(b).alias("__ly"), *[F.lit(v).cast("double").alias(c) for c, v in zip(("__wx", "__wy"), w)])
    pairs = F.array(*[pair(a, b, *wide.get((a, b), (None, None))) for a, b in [r[:2] for r in levels] or [(0, 0)]])
    side = lambda c: F.pow(F.lit(2.0), F.col(c)) * (size / _FINE)
    bin_of = lambda c, l: F.floor(c / side(l)).cast("long")
    # So far before a point that, however differences are rounded, boxes that hold it begin later.
    before = lambda c, w: F.when(F.abs(c) < math.inf, F.col(c) - (F.col(w) + (F.abs(c) + F.col(w)) * 2.0**-50))
    at = ["__lx", "__ly", "__bx", "__by"]
    by_corner = F.array_contains(F.array(*[pair(*k) for k in wide]), F.struct("__lx", "__ly")) if wide else F.lit(False)
    spread = sized.withColumn("__corner", by_corner)
    for c in "xy":
        lo, hi = (bin_of(F.col(c + e), f"__l{c}") for e in "01")
        spread = spread.withColumn(f"__b{c}", F.explode(F.sequence(lo, F.when(F.col("__corner"), lo).otherwise(hi))))
    # As many parts as a shuffle has: the rows that come out are many more than those that go in.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = materialised(points.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / _HELD).alias("__n")).where("__n > 1"))
    held = points.withColumn("__part", F.lit(0).cast("long"))
    if not crowded.isEmpty():
        n = F.coalesce("__n", F.lit(1))
        held = with_groups(points, crowded, ["x", "y"], "left").withColumn("__part", F.floor(F.rand(0) * n).cast("long")).drop("__n")
    own = [c for c in points.columns if c not in ("x", "y")]
    places = held.groupBy("x", "y", "__part").agg(F.collect_list(F.struct(*own)).alias("__own"))
    placed = places.select("x", "y", "__own", F.inline(pairs))
    for c in "xy":
        hi = bin_of(F.col(c), f"__l{c}")
        placed = placed.withColumn(f"__b{c}", F.explode(F.sequence(F.coalesce(bin_of(before(c, f"__w{c}"), f"__l{c}"), hi), hi)))
    # Merged, so that places lead and no side is held whole.
    met = placed.drop("__wx", "__wy").repartition(parts, *at).hint("merge").join(spread.drop("__corner").repartition(parts, *at), at)
    inside = met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.select("x", "y", *boxes.columns, F.inline("__own")).select(*points.columns, *boxes.columns)


def asserted(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows, whose reading fails with the name of the first check that a row does not meet; null counts as not met."""
    broken = F.lit(None).cast("boolean")
    for name, holds in reversed(checks.items()):
        broken = F.when(~F.coalesce(holds, F.lit(False)), F.raise_error(F.lit(f"check failed: {name}")).cast("boolean")).otherwise(broken)
    return rows.where(broken.isNull())


def uniform_or_error(meta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """meta, whose reading fails where rows of one key differ in a column: rasters of a set in one CRS, grid and size."""
    ends = meta.groupBy(*keys).agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b"), F.count(c).alias("n")).alias(f"__{c}") for c in columns], F.count(F.lit(1)).alias("__rows"))
    same = lambda c: (F.col(f"__{c}.a") == F.col(f"__{c}.b")) & (F.col(f"__{c}.n") == F.col("__rows"))
    checked = asserted(with_groups(meta, ends, keys), {f"one {c} in a set": same(c) for c in columns})
    return checked.select(*meta.columns)


def aligned_layers(base: DataFrame, layers: dict[str, DataFrame | None], on: list[str]) -> DataFrame:
    """base with a column for each layer (on, value) at the same cell; a layer that is missing as a whole gives nulls."""
    for name, layer in layers.items():
        if layer is None:
            base = base.withColumn(name, F.lit(None).cast("double"))
        else:
            base = base.join(layer.select(*on, F.col("value").alias(name)), on, "left")
    return base
