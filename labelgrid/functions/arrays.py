"""Per-pixel band algebra on array columns, by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(bands: Column) -> Column:
    return bands.cast("array<double>")


def argmax(bands: Column) -> Column:
    """Index from 0 of the largest band; the first of equals."""
    return (F.array_position(bands, F.array_max(bands)) - 1).cast("int")


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held between low and high; null and NaN pass as Spark's greatest and least have them."""
    if low is not None:
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))
    if high is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(float(high))))
    return x


def total(bands: Column) -> Column:
    return F.aggregate(bands, F.lit(0.0), lambda a, x: a + x)


def softmax(bands: Column) -> Column:
    """exp(x - max) over its sum; both are taken once for an array."""
    one = lambda v, use: F.transform(F.array(v), use)[0]
    raised = one(F.struct(bands.alias("b"), F.array_max(bands).alias("top")), lambda s: F.transform(s["b"], lambda x: F.exp(x - s["top"])))
    return one(raised, lambda e: one(F.struct(e.alias("e"), total(e).alias("sum")), lambda s: F.transform(s["e"], lambda x: x / s["sum"])))


def group_max(bands: Column, groups: dict[int, int], n: int) -> Column:
    """n merged bands: each the largest of the bands mapped to it; 0 where none is."""
    sources = [[s for s, d in groups.items() if d == k] for k in range(n)]
    return F.array(
        *[F.greatest(*[bands[s] for s in ss], bands[ss[0]]) if ss else F.lit(0.0) for ss in sources]
    )


def logits(bands: Column) -> Column:
    return F.transform(bands, lambda p: F.ln(p + F.lit(1e-8)))


def unary_potentials(bands: Column) -> Column:
    return F.transform(bands, lambda p: -F.ln(clip(p, 0, 1) + F.lit(1e-3)))


def correct_water(bands: Column, water: Column, index: int = 0, strength: float = 0.5) -> Column:
    """Probabilities whose water logit is raised to strength where water holds, softmaxed again."""
    raised = F.transform(logits(bands), lambda x, i: F.when(water & (i == index), F.lit(strength)).otherwise(x))
    return softmax(raised)


def standardise(bands: Column, mean: list[float], std: list[float]) -> Column:
    zipped = F.arrays_zip(bands.alias("x"), F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, std)).alias("s"))
    return F.transform(zipped, lambda z: (z["x"] - z["m"]) / z["s"])


def elementwise_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def mean_of(*arrays: Column) -> Column:
    """Element-wise mean, as of predictions over flipped copies."""
    out = arrays[0]
    for a in arrays[1:]:
        out = elementwise_sum(out, a)
    return F.transform(out, lambda x: x / F.lit(float(len(arrays))))


def ndvi(nir: Column, red: Column, wrap8: bool = False) -> Column:
    """(nir - red) / (nir + red + 1e-7) + 1 within [0, 2]; wrap8 takes sums and differences modulo 256."""
    difference, added = nir - red, nir + red
    if wrap8:
        difference, added = F.pmod(difference, F.lit(256)), F.pmod(added, F.lit(256))
    return clip(difference / (added + F.lit(1e-7)) + F.lit(1.0), 0, 2)
