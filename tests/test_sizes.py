"""What only shows on larger tables: long numbers, points on sides, low values, many rows in one place."""

from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from labelgrid.operators import components, polygons, raster, superpixels, whole


def test_a_height_has_no_nodata(spark):
    """Differences below the limit of no-data stay what they are, so the percentile can be below zero."""
    px = spark.createDataFrame([(0, 100.0, 100.0 + 10000.0 * k) for k in range(2, 6)] + [(1, 5.0, 2.0), (1, -9999.0, 1.0)], "image int, dsm double, dem double")
    got = sorted((r["image"], round(r["height"], 6)) for r in raster.surface_height(px, ["image"], "dsm", "dem").collect())
    assert got == [(0, -20030.0)] * 4 + [(1, 0.0), (1, 2.996)]


def test_long_numbers_of_paths(spark):
    """Numbers of more digits than a path has room for are cut, as the query's SQL has it."""
    from labelgrid.catalogue import more

    n = [7, 999999, 1000000, 2630264]
    rows = spark.createDataFrame([(k, "O", "2-HIGH") for k in n], "o_orderkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.lit("2000-12-31").cast("timestamp"))
    with mock.patch.object(more, "table", lambda *_: rows):
        got = {r["o_orderkey"]: r["pair"] for r in more.j11_x03_x04_x09_x12_paths_and_dates(spark, "").collect()}
    assert got == {7: "pair-000007.png", 999999: "pair-999999.png", 1000000: "pair-100000.png", 2630264: "pair-263026.png"}


def test_points_on_slanted_sides(spark):
    """Where a side crosses a point's height is reckoned from its first end, with the plain rule's rounding."""
    rings = [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.5), (1.5, 1.5), (1.5, 4.0), (0.0, 3.0)], [(0.3, 0.3), (0.9, 0.35), (0.6, 1.1)]]
    rings = {k: [[(k % 6 + x, k % 7 * 0.8 + y) for x, y in ring] for ring in rings] for k in range(25)}
    on = {(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]), y) for rs in rings.values() for ring in rs for a, b in zip(ring, ring[1:] + ring[:1]) if a[1] != b[1] for y in (i / 10 for i in range(97))}
    points = [(i, x, y) for i, (x, y) in enumerate(sorted(on))]

    def holds(x, y, ring):
        return sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x for a, b in zip(ring, ring[1:] + ring[:1]))

    want = {(i, k) for i, x, y in points for k, rs in rings.items() if sum(holds(x, y, r) for r in rs) % 2}
    shapes = spark.createDataFrame([(k, [list(p) for p in r]) for k, rs in rings.items() for r in rs], "k int, ring array<array<double>>")
    got = polygons.points_in_polygons(spark.createDataFrame(points, "i int, x double, y double"), polygons.edges_of(shapes, "k", "ring"), "k", 0.7)
    assert {(r["i"], r["k"]) for r in got.collect()} == want


def test_small_blocks_share_a_task(spark, monkeypatch):
    """Very many small images are read in a few groups, and as they are one by one."""
    from labelgrid.operators import warp

    monkeypatch.setattr(warp, "PACKED_PLACES", 50)
    px = spark.createDataFrame([(k, r, c, float(k + r * c)) for k in range(40) for r in range(4) for c in range(4)], "image int, row int, col int, v double")
    sizes = px.select("image").distinct().withColumns({"height": F.lit(4), "width": F.lit(4)})
    places = px.select("image", "row", "col", F.col("row").cast("double").alias("sy"), (F.col("col") * 0.5).alias("sx"))
    out = warp.sampled(px, ["image"], "v", places, sizes, "bilinear", block=4)
    got = {(r["image"], r["row"], r["col"]): r["v"] for r in out.collect()}
    assert got == {(k, r, c): k + r * c * 0.5 for k in range(40) for r in range(4) for c in range(4)}
    assert "__pack" in out._jdf.queryExecution().toString()


def test_frames_drawn_where_they_are(spark):
    """Meshes of frames, partly behind the near plane, as drawn() has them triangle by triangle."""
    import random

    from labelgrid.operators import meshes

    rng = random.Random(8)
    mesh = [(0, 1, 2), (1, 3, 2), (2, 3, 4), (0, 4, 1)]
    frames = [(f, [(rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-2, 12), rng.randrange(4)) for _ in range(5)]) for f in range(30)]
    camera = [[10.0, 0.5, 10.0, 0.0], [0.0, 10.0, 8.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    p = "struct<right: double, down: double, ahead: double, label: long>"
    rows = spark.createDataFrame(frames, f"f int, p array<{p}>")
    each = rows.select("f", F.explode(F.array(*[F.array(*map(F.lit, t)) for t in mesh])).alias("t"), "p")
    v = lambda k: F.get("p", F.get("t", F.lit(k)))
    tri = each.select("f", *[F.struct(v(k)["right"].alias("right"), v(k)["down"].alias("down"), v(k)["ahead"].alias("ahead")).alias(n) for k, n in enumerate("abc")], v(2)["label"].alias("label"))
    want = {tuple(r) for r in meshes.drawn(tri, ["f"], "label", camera, 20, 16, 1.0).collect()}
    assert {tuple(r) for r in meshes.drawn_frames(rows, ["f"], "p", mesh, camera, 20, 16, 1.0).collect()} == want and len(want) > 500


def test_small_images_have_whole_superpixels(spark, monkeypatch):
    """Very many small images, some with holes, are cut to superpixels without a join, and as images are that have many blocks."""
    rng = np.random.default_rng(12)
    rows = [(str(k) if k else None, r, c, [float(rng.integers(0, 60)), c * 3.0]) for k in range(30) for r in range(9) for c in range(11) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "image string, row int, col int, features array<double>").repartition(3)
    monkeypatch.setattr(whole, "ROWS", 250)

    def cut(px):
        found = superpixels.slic(px, ["image"], "features", 9, 11, 9, 8.0, 2)
        return found, superpixels.connected(found, ["image"], "segment", 9, 11, 5)

    found, joined = cut(px)
    assert "Join" not in joined._jdf.queryExecution().toString()
    every = {tuple(r) for r in found.collect()}, {tuple(r) for r in joined.collect()}
    assert len(every[0]) == len(every[1]) == len(rows) and every[0] != every[1]
    few = {str(k) for k in range(1, 5)}
    some = px.where(F.col("image").isin(*few))
    monkeypatch.setattr(components, "BLOCK", 8)
    for mine, theirs in zip(every, cut(some)):
        assert {r for r in mine if r[0] in few} == {tuple(r) for r in theirs.collect()}


def test_a_lattice_moves_blocks(spark, monkeypatch):
    """Whatever blocks and cells there are, probabilities are the same; no table has a row for each pixel, much less for each corner."""
    from labelgrid.plans import lattice_crf

    rng = np.random.default_rng(13)
    rows = [(k, r, c, [p, 1 - p], [float(rng.normal(c, 5)), float(rng.normal(0, 9))], float(rng.random())) for k in range(2) for r in range(21) for c in range(26) for p in [float(rng.random())]]
    px = spark.createDataFrame(rows, "image int, row int, col int, probs array<double>, features array<double>, z double").repartition(3)
    kept, write = [], lattice_crf.materialised

    def watched(df):
        kept.append(write(df))
        return kept[-1]

    monkeypatch.setattr(lattice_crf, "materialised", watched)
    found = []
    for block, cell in ((128, 48), (7, 3)):
        monkeypatch.setattr(lattice_crf, "BLOCK", block, raising=False)
        monkeypatch.setattr(lattice_crf, "CELL", cell, raising=False)
        out = lattice_crf.refined_on_lattice(px, ["image"], 2, 4.0, [9.0, 12.0], 1.5, (1.0, 2.0), 2, "z", (0.7, 0.9))
        found.append({(r["image"], r["row"], r["col"]): r["classes"] for r in out.collect()})
    assert len(found[0]) == len(rows) and found[0].keys() == found[1].keys()
    assert max(abs(a - b) for p in found[0] for a, b in zip(found[0][p], found[1][p])) < 1e-9
    assert max(t.count() for t in kept) < len(rows) / 20


def test_small_images_are_split_whole(spark, monkeypatch):
    """Very many small images, some with holes, are split without a join, and as images are that have many blocks."""
    rng = np.random.default_rng(14)
    rows = [(str(k) if k else None, r, c, "abc"[int(rng.integers(0, 3))]) for k in range(30) for r in range(9) for c in range(11) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "image string, row int, col int, label string").repartition(3)
    monkeypatch.setattr(whole, "ROWS", 250)
    monkeypatch.setattr(components, "CELLS", 400)
    whole_ones = components.split_segments(px, ["image"], "label", 9, 11)
    assert "Join" not in whole_ones._jdf.queryExecution().toString()
    every = {tuple(r) for r in whole_ones.collect()}
    assert len(every) == len(rows) and {r[0] for r in every} == {str(k) if k else None for k in range(30)}
    some = px.where("image IS NOT NULL")
    monkeypatch.setattr(components, "BLOCK", 5)
    assert {r for r in every if r[0] is not None} == {tuple(r) for r in components.split_segments(some, ["image"], "label", 9, 11).collect()}


def test_small_blocks_of_regions_share_a_task(spark):
    """Blocks are labelled many at a time: no group of its own for each."""
    px = spark.createDataFrame([(k, r, c, (r * c + k) % 2) for k in range(40) for r in range(4) for c in range(4)], "image int, row int, col int, label int")
    out = components.regions(px, ["image"], "label", 4, 4)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan
    got = {(r["image"], r["row"], r["col"]): r["region"] for r in out.collect()}
    assert len(got) == 640 and got[0, 3, 2] == got[0, 0, 0] == 0 and got[0, 3, 3] == 15 and got[1, 3, 3] == 15
