"""Superpixels and polygons against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from labelgrid.operators import polygons, relational, resample, superpixels


def pixels(spark, a):
    h, w, _ = a.shape
    return spark.createDataFrame([(0, r, c, [float(v) for v in a[r, c]]) for r in range(h) for c in range(w)], "image int, row int, col int, features array<double>").repartition(3)


def plain_slic(a, segments, compactness, rounds):
    h, w, n = a.shape
    step = math.sqrt(h * w / segments)
    down, across = max(1, round(h / step)), max(1, round(w / step))
    cell = np.array([[(min(down - 1, int(r * (down / h))), min(across - 1, int(c * (across / w)))) for c in range(w)] for r in range(h)])
    centres = {}
    for i in range(down):
        for j in range(across):
            own = (cell[:, :, 0] == i) & (cell[:, :, 1] == j)
            centres[i, j] = ((i + 0.5) * h / down - 0.5, (j + 0.5) * w / across - 0.5, a[own].mean(axis=0))
    for k in range(rounds + 1):
        out = np.zeros((h, w), int)
        for r in range(h):
            for c in range(w):
                i, j = cell[r, c]
                near = [(p, q) for p in (i - 1, i, i + 1) for q in (j - 1, j, j + 1) if (p, q) in centres]
                d = lambda s: ((a[r, c] - centres[s][2]) ** 2).sum() + (compactness / step) ** 2 * ((r - centres[s][0]) ** 2 + (c - centres[s][1]) ** 2)  # noqa: B023, E731
                best = min(near, key=lambda s: (d(s), s[0] * across + s[1]))
                out[r, c] = best[0] * across + best[1]
        if k < rounds:
            for (i, j), old in list(centres.items()):
                rows, cols = np.nonzero(out == i * across + j)
                if len(rows):
                    centres[i, j] = (rows.mean(), cols.mean(), a[rows, cols].mean(axis=0))
    return out


def test_slic(spark):
    rng = np.random.default_rng(1)
    a = np.stack([(np.indices((18, 25))[1] > 11) * 50.0, rng.random((18, 25)) * 30], axis=2)
    out = {(r["row"], r["col"]): r["segment"] for r in superpixels.slic(pixels(spark, a), ["image"], "features", 18, 25, 12, 8.0, 3).collect()}
    want = plain_slic(a, 12, 8.0, 3)
    assert all(out[p] == want[p] for p in np.ndindex(18, 25)) and len(set(out.values())) > 6
    assert superpixels.slic(pixels(spark, a).limit(0), ["image"], "features", 18, 25).count() == 0


def test_small_pieces_join_their_longest_border(spark):
    a = np.array([[0, 0, 0, 1, 1], [0, 2, 0, 1, 1], [0, 0, 3, 1, 1], [0, 0, 3, 1, 4], [5, 0, 3, 1, 4], [5, 5, 5, 5, 5]])
    labels = spark.createDataFrame([(0, r, c, int(a[r, c])) for r in range(6) for c in range(5)], "image int, row int, col int, s int")
    out = np.zeros(a.shape, int)
    for r in superpixels.connected(labels, ["image"], "s", 6, 5, 4).collect():
        out[r["row"], r["col"]] = r["s"]
    want = a.copy()
    want[1, 1] = 0
    want[a == 3] = 1  # three sides against three of the zeros and one of the fives: the piece of first pixel among equals
    want[a == 4] = 1
    zeros, ones = ((a == 0) & (np.roll(a == 3, -1, 1))).sum() + 1, ((a == 1) & np.roll(a == 3, 1, 1)).sum()
    if zeros >= ones:
        want[a == 3] = 0
    assert np.array_equal(out, want)


def inside(x, y, rings):
    n = 0
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 <= y) != (y1 <= y):
                n += x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x
    return n % 2 == 1


def test_points_in_polygons(spark):
    """Stars, rings with holes, polygons over each other, points on corners and sides; cells larger and smaller than polygons."""
    rng = random.Random(3)
    shapes = {}
    for k in range(12):
        cx, cy = rng.uniform(-5, 5), rng.uniform(-5, 5)
        star = [(round(cx + rng.uniform(0.5, 3) * math.cos(t * math.pi / 6), 2), round(cy + rng.uniform(0.5, 3) * math.sin(t * math.pi / 6), 2)) for t in range(12)]
        shapes[k] = [star] + ([[(cx - 0.2, cy - 0.2), (cx + 0.2, cy - 0.2), (cx, cy + 0.2)]] if k % 2 else [])
    shapes[20] = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]
    points = [(i, round(rng.uniform(-9, 9), 1), round(rng.uniform(-9, 9), 1)) for i in range(600)] + [(900, 0.0, 0.0), (901, 2.0, 1.0), (902, 1.0, 2.0), (903, 0.0, 1.0), (904, 1.0, 0.0)]
    want = {(i, k) for i, x, y in points for k, rings in shapes.items() if inside(x, y, rings)}
    assert {(900, 20), (903, 20), (904, 20)} <= want and not {(901, 20), (902, 20)} & want
    rings = spark.createDataFrame([(k, [list(map(float, p)) for p in ring]) for k, rs in shapes.items() for ring in rs] + [(99, None), (98, [[0.0, 0.0], [1.0, 1.0]])], "k int, ring array<array<double>>")
    edges = polygons.edges_of(rings, "k", "ring")
    px = spark.createDataFrame(points, "i int, x double, y double").withColumn("mine", F.lit("kept"))
    for size in (0.3, 2.0, 50.0):
        got = polygons.points_in_polygons(px, edges, "k", size)
        assert got.columns == ["i", "x", "y", "mine", "k"] and {(r["i"], r["k"]) for r in got.collect()} == want


def test_nearest_where_targets_are_dense(spark):
    """Two clusters, one place with many targets, and points with none in reach: as all pairs have it."""
    rng = random.Random(6)
    targets = [(k, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for k in range(400)] + [(500 + k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(60)] + [(700 + k, 5.0, 5.0) for k in range(90)]
    points = [(i, rng.gauss(0, 0.02), rng.gauss(0, 0.02)) for i in range(200)] + [(300 + i, rng.uniform(-12, 12), rng.uniform(-12, 12)) for i in range(200)] + [(900, 5.0, 5.2)]
    want = {}
    for i, x, y in points:
        d, t = min(((x - a) * (x - a) + (y - b) * (y - b), k) for k, a, b in targets)
        if d <= 1.5 * 1.5:
            want[i] = t
    got = resample.nearest_within(spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(targets, "t int, x double, y double"), "i", "t", 1.5)
    assert {r["i"]: r["t"] for r in got.collect()} == want and want[900] == 700


def test_boxes_of_all_sizes(spark):
    rng = random.Random(7)
    boxes = [(k, x, y, x + w, y + w * rng.random()) for k in range(80) for x, y, w in [(rng.uniform(-50, 50), rng.uniform(-50, 50), 10 ** rng.uniform(-3, 3))]] + [(99, 1.0, 1.0, 1.0, 1.0)]
    points = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(400)] + [(999, 1.0, 1.0)]
    want = {(i, k) for i, x, y in points for k, a, b, c, d in boxes if a <= x <= c and b <= y <= d}
    px, bx = spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double")
    got = relational.binned_box_join(px, bx, 1.0)
    assert {(r["i"], r["k"]) for r in got.collect()} == want and (999, 99) in want
    assert relational.binned_box_join(px, bx.limit(0), 1.0).count() == 0


def test_the_fewer_of_points_and_boxes_move_often(spark, monkeypatch):
    """Many boxes go to one bin each and few points to several, and the other way round; boxes beyond all points stay where they are."""
    rng = random.Random(8)
    some = lambda n: [(i, rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(n)]
    moved = []

    def watched(df, *to):
        moved.append(df)
        return deal(df, *to)

    deal = type(spark.range(1)).repartition
    for n, m in ((60, 2000), (2000, 60)):
        points = [*some(n), (9000, math.nan, 1.0), (9001, math.inf, 1.0), (9002, None, 1.0), (9003, 3.0, 3.0)]
        boxes = [(k, x, y, x + 8.0, y + 3.0) for k, x, y in some(m)] + [(9100, 3.0, 3.0, 11.0, 6.0), (9101, None, 1.0, 2.0, 2.0), (9102, 5.0, 5.0, 4.0, 9.0), *[(k, 1e6, 1e6, 1e6 + 8, 1e6 + 3) for k in range(9200, 9300)]]
        want = {(i, k) for i, x, y in points for k, a, b, c, d in boxes if None not in (x, a) and a <= x <= c and b <= y <= d}
        px, bx = spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double")
        found = relational.binned_box_join(px.where("NOT isnan(x) AND x < 1e9"), bx, 8.0).collect()
        moved.clear()
        monkeypatch.setattr(type(px), "repartition", watched)
        got = relational.binned_box_join(px, bx, 8.0)
        monkeypatch.undo()
        for rows in (got.collect(), found):
            assert len(rows) == len(want) and {(r["i"], r["k"]) for r in rows} == want and (9003, 9100) in want
        assert len(moved) == 2 and sum(df.count() for df in moved) < 2 * max(n, m)


def test_many_boxes_at_far_places(spark):
    """Boxes so narrow, and so far away, that sides and differences are rounded; points lie on their corners."""
    rng = random.Random(9)
    for far, wide in ((1e9, 1e-3), (1e15, 0.3), (-3e7, 1e-7), (0.0, 0.1)):
        corners = [(far + rng.randrange(40) * wide / 4, far + rng.randrange(40) * wide / 4) for _ in range(300)]
        boxes = [(k, x, y, x + wide, y + wide) for k, (x, y) in enumerate(corners)]
        points = [(i, *at) for i, at in enumerate(rng.sample([at for _, a, b, c, d in boxes for at in ((a, b), (c, d), (a, d))], 80))]
        want = sorted((i, k) for i, x, y in points for k, a, b, c, d in boxes if a <= x <= c and b <= y <= d)
        px, bx = spark.createDataFrame(points, "i int, x double, y double"), spark.createDataFrame(boxes, "k int, x0 double, y0 double, x1 double, y1 double")
        for size in (wide, 1.0):
            assert sorted((r["i"], r["k"]) for r in relational.binned_box_join(px, bx, size).collect()) == want and len(want) > 300
