"""Lenses undone, grey values equalised and tiles scored four ways, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.functions import geometry
from labelgrid.operators import equalise, warp
from labelgrid.plans import inference

LENS, SIDE = (-0.25, 0.1, 0.0), (0.001, -0.002)
CAMERA = [[60.0, 0.0, 31.0], [0.0, 62.0, 24.0], [0.0, 0.0, 1.0]]


def bent(x, y):
    r2 = x * x + y * y
    radial = 1 + sum(c * r2**n for n, c in enumerate(LENS, 1))
    return x * radial + 2 * SIDE[0] * x * y + SIDE[1] * (r2 + 2 * x * x), y * radial + SIDE[0] * (r2 + 2 * y * y) + 2 * SIDE[1] * x * y


def test_optimal_camera():
    """At 0 all of the view has a source, and its border touches the image's; at 1 the image's border is in view."""
    inner = geometry.optimal_camera(CAMERA, LENS, SIDE, 64, 50)
    outer = geometry.optimal_camera(CAMERA, LENS, SIDE, 64, 50, 1.0)
    border = [(u, v) for u in range(64) for v in (0, 49)] + [(u, v) for v in range(50) for u in (0, 63)]

    def source(camera, u, v):
        x, y = bent((u - camera[0][2]) / camera[0][0], (v - camera[1][2]) / camera[1][1])
        return x * 60 + 31, y * 62 + 24

    seen = [source(inner, u, v) for u, v in border]
    assert all(-0.3 <= u <= 63.3 and -0.3 <= v <= 49.3 for u, v in seen)
    assert min(min(u, 63 - u, v, 49 - v) for u, v in seen) < 0.5
    far = [source(outer, u, v) for u, v in border]
    assert min(u for u, _ in far) <= 0.3 and max(u for u, _ in far) >= 62.7
    straight = geometry.optimal_camera(CAMERA, (0.0,), (0.0, 0.0), 64, 50)
    assert np.allclose(straight, CAMERA)


def test_image_without_its_lens(spark):
    """A ramp seen through the lens: each new pixel has the value of where its ray went."""
    rows = [(0, r, c, r + 100.0 * c) for r in range(50) for c in range(64)]
    new = geometry.optimal_camera(CAMERA, LENS, SIDE, 64, 50, 0.5)
    out = warp.without_lens(spark.createDataFrame(rows, "image int, row int, col int, v double"), ["image"], "v", 50, 64, CAMERA, LENS, SIDE, new, "bilinear", 16).collect()
    assert len(out) == 64 * 50
    for r in out:
        x, y = bent((r["col"] - new[0][2]) / new[0][0], (r["row"] - new[1][2]) / new[1][1])
        u, v = x * 60 + 31, y * 62 + 24
        if not (-0.5 <= u <= 63.5 and -0.5 <= v <= 49.5):
            assert r["v"] is None
        elif 0 <= u <= 63 and 0 <= v <= 49:
            assert r["v"] == pytest.approx(v + 100 * u, abs=1e-6)


@pytest.mark.parametrize("clip", [1.0, 3.0, 1000.0])
def test_equalised(spark, clip):
    rng = np.random.default_rng(4)
    a = np.clip(rng.normal(90, 20, (23, 31)), 0, 255).astype(int)
    tile, levels = 8, 256
    maps = {}
    for i in range(3):
        for j in range(4):
            own = a[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
            hist = np.bincount(own.ravel(), minlength=levels)
            limit = max(1, int(clip * own.size // levels))
            over = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + over // levels + (np.arange(levels) < over % levels)
            maps[i, j] = np.cumsum(hist) * (levels - 1) / own.size
    got = {(r["row"], r["col"]): r["v"] for r in equalise.equalised(spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(23) for c in range(31)], "image int, row int, col int, v int"), ["image"], "v", 23, 31, tile, clip).collect()}
    for (r, c), v in np.ndenumerate(a):
        y, x = (r + 0.5) / tile - 0.5, (c + 0.5) / tile - 0.5
        i, j = math.floor(y), math.floor(x)
        want = sum(
            (1 - abs(y - i - p)) * (1 - abs(x - j - q)) * maps[min(2, max(0, i + p)), min(3, max(0, j + q))][v] for p in (0, 1) for q in (0, 1)
        )
        assert got[r, c] == pytest.approx(want, abs=1e-9)


def test_four_flips(spark):
    rng = np.random.default_rng(5)
    tiles = rng.random((5, 6, 4, 2))
    kernel = rng.random((2, 3))

    def model():
        import numpy as np

        return lambda x: np.cumsum(np.cumsum(x, axis=1), axis=2) @ kernel

    df = spark.createDataFrame([(k, t.ravel().tolist()) for k, t in enumerate(tiles)], "tile int, data array<double>")
    got = {r["tile"]: np.array(r["data"]).reshape(6, 4, 3) for r in inference.predicted(df, "data", (6, 4, 2), model, 3, batch=2).collect()}
    score = model()
    for k, t in enumerate(tiles):
        ways = [score(t[None, ::a, ::b])[0][::a, ::b] for a in (1, -1) for b in (1, -1)]
        assert np.allclose(got[k], sum(ways) / 4, atol=1e-6)


def test_absent_lens_is_no_change(spark):
    one = spark.createDataFrame([(0.3, -0.2)], "x double, y double")
    out = one.select(F.inline(F.array(geometry.undistorted(F.col("x"), F.col("y"), (0.0,), (0.0, 0.0))))).first()
    assert tuple(out) == (0.3, -0.2)
