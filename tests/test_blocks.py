"""Operators on images cut to blocks: focal windows, warps, reprojection, contour splits, and the lattice of the dense CRF."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.functions import arrays, geometry
from labelgrid.operators import components, raster, tables, warp
from labelgrid.plans import experiments, lattice_crf, small_crf


def image(spark, a, name="v", key=0):
    rows = [(key, r, c, a[r, c].tolist()) for r in range(a.shape[0]) for c in range(a.shape[1]) if not (a.ndim == 2 and a.dtype.kind == "f" and np.isnan(a[r, c]))]
    kind = "array<double>" if a.ndim == 3 else "long" if a.dtype.kind in "iu" else "double"
    return spark.createDataFrame(rows, f"image int, row int, col int, {name} {kind}").repartition(4)


def back(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def around(a, r, op):
    h, w = a.shape[:2]
    return np.array([[op(a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1].reshape(-1, *a.shape[2:])) for j in range(w)] for i in range(h)])


@pytest.mark.parametrize("block, r", [(64, 1), (7, 3), (5, 8)])
@pytest.mark.parametrize("kind", ["max", "min", "sum", "or"])
def test_focal_dense(spark, monkeypatch, block, r, kind):
    monkeypatch.setattr(raster, "FOCAL_BLOCK", block)
    a = np.random.default_rng(r).integers(0, 1000, (23, 31))
    op = {"max": np.max, "min": np.min, "sum": np.sum, "or": lambda x: np.bitwise_or.reduce(x)}[kind]
    px = image(spark, a).withColumn("other", F.concat(F.lit("mine "), F.col("row")))
    out = raster.focal_dense(px, ["image"], "v", r, kind)
    assert out.columns == px.columns and out.where(F.col("other") == F.concat(F.lit("mine "), F.col("row"))).count() == a.size
    assert np.array_equal(back(out, a.shape), around(a, r, op))


def test_focal_dense_of_arrays_and_absent_values(spark, monkeypatch):
    monkeypatch.setattr(raster, "FOCAL_BLOCK", 6)
    a = np.random.default_rng(5).random((13, 17, 3))
    out = raster.focal_dense(image(spark, a), ["image"], "v", 2, "max")
    got = np.zeros(a.shape)
    for r in out.collect():
        got[r["row"], r["col"]] = r["v"]
    assert np.array_equal(got, around(a, 2, lambda x: x.max(axis=0)))
    few = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, None), (0, 9, 9, None)], "image int, row int, col int, v double")
    assert {tuple(r) for r in raster.focal_dense(few, ["image"], "v", 1, "max").collect()} == {(0, 0, 0, 1.0), (0, 0, 1, 1.0), (0, 9, 9, None)}


def test_boundaries_of_many_classes(spark):
    rng = np.random.default_rng(6)
    rows = [(0, r, c, int(rng.integers(0, 70)), int(rng.integers(0, 70))) for r in range(12) for c in range(12)]
    px = spark.createDataFrame(rows, "image int, row int, col int, g int, p int")
    hard = px.withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(69)), lambda k: (k == F.col("p")).cast("double")))
    bits = {tuple(r) for r in raster.boundary_sums(px, ["image"], "g", "p", list(range(70))).collect()}
    assert len(bits) == 70 and bits == {tuple(r) for r in raster.soft_boundary_sums(hard, ["image"], "g", "probs", list(range(70))).collect()}


def test_softmax_of_long_arrays(spark):
    v = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda x: (x * (F.col("id") + 1) % 17).cast("double")).alias("v"))
    out = v.select("v", arrays.softmax(F.col("v")).alias("s")).first()
    want = np.exp(np.array(out["v"]) - max(out["v"]))
    assert np.allclose(out["s"], want / want.sum())


def test_many_trials(spark, monkeypatch):
    monkeypatch.setattr(experiments, "TOGETHER", 10)
    data, trials = spark.range(20).select(F.col("id").cast("double").alias("x")), spark.range(35).select(F.col("id").alias("trial"))
    got = {r["trial"]: r["loss"] for r in experiments.evaluated(trials, data, F.abs(F.col("x") - F.col("trial")), ["trial"]).collect()}
    assert got == {t: sum(abs(x - t) for x in range(20)) / 20 for t in range(35)}


def cubic(t):
    d = abs(t)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0


def read(a, y, x, kernel):
    h, w = a.shape
    at = lambda i, j: a[min(max(i, 0), h - 1), min(max(j, 0), w - 1)]
    if kernel == "nearest":
        return at(math.floor(y + 0.5), math.floor(x + 0.5))
    i, j = math.floor(y), math.floor(x)
    weight = cubic if kernel == "cubic" else lambda t: max(0.0, 1 - abs(t))
    return sum(weight(y - i - p) * weight(x - j - q) * at(i + p, j + q) for p in range(-1, 3) for q in range(-1, 3))


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("places, block", [(1 << 19, 8), (20, 11)])
def test_sampled(spark, monkeypatch, kernel, places, block):
    """Places in and beside an image, in blocks that one task or several hold."""
    monkeypatch.setattr(warp, "PLACES", places)
    a = np.random.default_rng(7).random((19, 26))
    rng = random.Random(8)
    asked = [(0, k, rng.uniform(-1, 19), rng.uniform(-1, 26)) for k in range(300)] + [(0, 900, -0.5, 25.5), (0, 901, None, 3.0), (0, 902, 18.5, 0.0), (0, 903, 3.0, 4.0)]
    sizes = spark.createDataFrame([(0, 19, 26)], "image int, height int, width int")
    out = warp.sampled(image(spark, a), ["image"], "v", spark.createDataFrame(asked, "image int, k int, sy double, sx double"), sizes, kernel, block)
    got = {r["k"]: r["v"] for r in out.collect()}
    for _, k, y, x in asked:
        if y is None or not (-0.5 <= y <= 18.5 and -0.5 <= x <= 25.5):
            assert got[k] is None
        else:
            assert got[k] == pytest.approx(read(a, y, x, kernel), abs=1e-9)


def test_absent_pixels_are_left_out(spark):
    a = np.ones((6, 6))
    a[2:, 3] = np.nan
    sizes = spark.createDataFrame([(0, 6, 6)], "image int, height int, width int")
    asked = spark.createDataFrame([(0, 0, 3.0, 2.4), (0, 1, 3.0, 2.6), (0, 2, 1.0, 3.0)], "image int, k int, sy double, sx double")
    got = {r["k"]: r["v"] for r in warp.sampled(image(spark, a), ["image"], "v", asked, sizes, "bilinear", 8).collect()}
    assert got == {0: 1.0, 1: None, 2: 1.0}


def test_utm_and_back(spark):
    places = [(lat, lon) for lat in (0.0, 12.3, 37.5, 60.0, 83.9) for lon in (-87.0, -86.99, -85.2, -84.0, -83.5)]
    df = spark.createDataFrame(places, "lat double, lon double")
    df = df.select("*", geometry.utm(F.col("lat"), F.col("lon"), 32616).alias("u")).select("*", geometry.lat_lon(F.col("u.x"), F.col("u.y"), 32616).alias("b"))
    for r in df.collect():
        assert abs(r["b"]["lat"] - r["lat"]) * 111e3 < 1e-3 and abs(r["b"]["lon"] - r["lon"]) * 111e3 * math.cos(math.radians(r["lat"])) < 1e-3


@pytest.mark.parametrize("kernel, most", [("nearest", 0.6), ("bilinear", 0.02), ("cubic", 0.01)])
def test_reprojection_there_and_back(spark, kernel, most):
    """A smooth image taken to metres and back; nearest moves values by half a pixel or less."""
    a = np.fromfunction(lambda i, j: np.sin(i / 6) + np.cos(j / 7), (40, 50))
    layouts = spark.createDataFrame([(0, 40, 50, -84.9, 38.2, 1e-4, 1e-4)], "image int, height int, width int, x0 double, y0 double, dx double, dy double")
    targets = tables.materialised(warp.target_layouts(layouts, ["image"], 32616))
    there = tables.materialised(warp.to_utm(image(spark, a), ["image"], "v", layouts, targets, 32616, kernel, 16))
    assert there.where("v IS NOT NULL").count() > 1600
    again = back(warp.to_degrees(there, ["image"], "v", targets, layouts, 32616, kernel, 16), a.shape)
    inner = again[4:-4, 4:-4]
    assert np.isfinite(inner).all() and np.abs(inner - a[4:-4, 4:-4]).max() < most


def parts_of(mask, diagonal):
    """Connected regions of a mask as sets, by first pixel."""
    left, out = set(zip(*np.nonzero(mask))), []
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    for p in sorted(left):
        if p in left:
            left.discard(p)
            part, stack = {p}, [p]
            while stack:
                i, j = stack.pop()
                for di, dj in steps:
                    if (q := (i + di, j + dj)) in left:
                        left.discard(q)
                        part.add(q)
                        stack.append(q)
            out.append(part)
    return out


def split(a):
    h, w = a.shape
    out, n = np.full(a.shape, -1), 0
    for s in np.unique(a):
        holes = [p for p in parts_of(a != s, False) if not any(i in (0, h - 1) or j in (0, w - 1) for i, j in p)]
        for part in parts_of(a == s, True) + holes:
            out[tuple(zip(*part))] = n
            n += 1
    return out


@pytest.mark.parametrize("block", [64, 5])
def test_contour_split(spark, monkeypatch, block):
    """Nested rings, corners that touch, and noise; over one block and many."""
    monkeypatch.setattr(components, "BLOCK", block)
    i, j = np.indices((21, 23))
    rings = (np.maximum(abs(i - 10), abs(j - 11)) // 3).astype(int) % 3
    noise = np.random.default_rng(9).integers(0, 3, (21, 23))
    checks = (i + j) % 2
    both = image(spark, rings).unionByName(image(spark, noise, key=1)).unionByName(image(spark, checks, key=2))
    out = components.split_segments(both, ["image"], "v", 21, 23).collect()
    for k, a in enumerate((rings, noise, checks)):
        got = np.full(a.shape, -2)
        for r in out:
            if r["image"] == k:
                got[r["row"], r["col"]] = r["segment"]
        assert np.array_equal(got, split(a))


def test_split_after_opening(spark):
    a = np.zeros((20, 20), int)
    a[3:12, 3:12], a[0, 15], a[15, 15] = 1, 1, 1
    out = {(r["row"], r["col"]): r["segment"] for r in components.split_segments(image(spark, a), ["image"], "v", 20, 20, opening=1).collect()}
    assert len({out[p] for p in ((3, 3), (11, 11))}) == 1 and out[0, 15] == -1 != out[0, 0] and len({out[0, 0], out[3, 3], out[15, 15], -1}) == 4


def exact(unary, places, features, theta, weights, steps):
    """Mean field as small_crf has it, with a pixel's own value in its sums."""
    alpha, beta, gamma = theta
    near = ((places[:, None] - places[None]) ** 2).sum(-1)
    alike = ((features[:, None] / beta - features[None] / beta) ** 2).sum(-1)
    total = 0
    for w, k in ((weights[0], np.exp(-near / (2 * gamma**2))), (weights[1], np.exp(-near / (2 * alpha**2) - alike / 2))):
        scale = 1 / np.sqrt(k.sum(1))
        total = total + w * k * scale[:, None] * scale[None]
    q = np.exp(-unary)
    q /= q.sum(1, keepdims=True)
    for _ in range(steps):
        q = np.exp(total @ q - unary)
        q /= q.sum(1, keepdims=True)
    return q


def test_lattice_against_all_pairs(spark):
    """Two noisy halves of a tile: probabilities within 0.05 of the exact ones for most pixels, labels nearly all equal."""
    rng = np.random.default_rng(10)
    n = 24
    truth = (np.indices((n, n))[1] >= n // 2).astype(int)
    first = np.clip(np.where(truth, 0.35, 0.65) + rng.normal(0, 0.15, (n, n)), 0.05, 0.95)
    colour = np.stack([truth * 40.0 + rng.normal(0, 4, (n, n)), truth * 30.0 + rng.normal(0, 4, (n, n))], axis=2)
    rows = [(0, r, c, [float(first[r, c]), float(1 - first[r, c])], colour[r, c].tolist()) for r in range(n) for c in range(n)]
    px = spark.createDataFrame(rows, "image int, row int, col int, probs array<double>, features array<double>").repartition(4)
    out = lattice_crf.refined_on_lattice(px, ["image"], 2, 8.0, [20.0, 15.0], 2.0, (1.0, 2.0), 2)
    got = np.zeros((n, n, 2))
    for r in out.collect():
        got[r["row"], r["col"]] = r["classes"]
    probs = np.stack([first, 1 - first], 2).reshape(-1, 2)
    want = exact(-np.log(probs + 1e-3), np.indices((n, n)).reshape(2, -1).T.astype(float), colour.reshape(-1, 2), (8.0, np.array([20.0, 15.0]), 2.0), (1.0, 2.0), 2).reshape(n, n, 2)
    apart = np.abs(got - want)[:, :, 0]
    assert np.quantile(apart, 0.9) < 0.05 and (got.argmax(2) == want.argmax(2)).mean() > 0.99 and (got.argmax(2) == truth).mean() > 0.98


def test_lattice_query_takes_all_steps(spark):
    """The query ends where five steps over all pairs end, and well away from where one does; steps that are not named are five."""
    from labelgrid.catalogue import blocks, rasters

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    px = rasters._crf_input(rasters.image(spark, d))
    rows = sorted(px.collect(), key=lambda r: (r["row"], r["col"]))
    got = {(r["row"], r["col"]): r["prob"] for r in blocks.m01_lattice_crf(spark, d).collect()}
    every = {(r["row"], r["col"]): r["prob"] for r in lattice_crf.refined_on_lattice(px, ["image"], 3, 5.0, 20.0, 2.0, (3.0, 5.0)).collect()}
    assert len(got) == len(rows) and got.keys() == every.keys() and max(abs(got[p] - every[p]) for p in got) < 1e-4
    held = [np.array([r[c] for r in rows], float) for c in ("probs", "features")]
    at = np.array([[r["row"], r["col"]] for r in rows], float)
    off = [np.abs(exact(-np.log(held[0] + 1e-3), at, held[1], (5.0, np.array([20.0]), 2.0), (3.0, 5.0), n).max(1) - [got[r["row"], r["col"]] for r in rows]).mean() for n in (1, 5)]
    assert off[1] < off[0] / 2


def test_corners_of_a_lattice():
    """Weights are shares, corners of neighbours meet, and a filter of ones has the shape of a Gaussian."""
    f = np.random.default_rng(11).random((1500, 3)) * 4
    places, weights = lattice_crf.corners(f)
    assert weights.min() > -1e-9 and np.allclose(weights.sum(1), 1)
    for k in (0, 1, 2):
        assert len(np.unique(places[:, :, k] % 4)) == 4
