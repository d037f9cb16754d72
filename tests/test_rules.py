"""Small cases worked out by hand for rules that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.catalogue import rasters
from labelgrid.functions import arrays, geometry, taxonomy, text
from labelgrid.operators import components, metrics, raster, relational, resample
from labelgrid.plans import experiments, small_crf
from labelgrid.sources import tables
from labelgrid.streaming import incremental


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def cm(spark, *matrices):
    rows = [(run, g, p, n) for run, m in enumerate(matrices) for g, row in enumerate(m) for p, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "run int, gt int, pred int, n long")


def test_iou_rules_for_absent_classes(spark):
    c = cm(spark, [[3, 1, 0], [0, 4, 0], [0, 0, 0]])
    iou = {r["class"]: r["iou"] for r in metrics.iou_per_class(c, ["run"], 3).collect()}
    assert iou == pytest.approx({0: 0.75, 1: 0.8, 2: 0.0})
    assert metrics.miou_zero_fill(c, ["run"], 3).first()["miou"] == pytest.approx(0.516667, abs=1e-6)
    assert metrics.miou_present(c, ["run"], 3).first()["miou"] == pytest.approx(0.775)
    assert [r["iou"] for r in metrics.iou_per_class(c, ["run"], 3, "keep").orderBy("class").collect()][2] is None


def test_micro_is_not_macro(spark):
    c = cm(spark, [[1, 0], [0, 1]], [[0, 1], [1, 0]]).withColumn("set", F.lit("s"))
    r = metrics.micro_and_macro(c, ["set", "run"], ["set"], 2).first()
    assert (r["miou_total"], r["trajectory_avg_miou"]) == pytest.approx((1 / 3, 0.5))


def test_vote_and_argmax_ties(spark):
    rows = spark.createDataFrame([(0, 1), (0, 1), (0, 3), (0, 3)], "s int, label int")
    assert {r["vote"] for r in metrics.segment_vote(rows, ["s"], "label").collect()} == {1}
    b = F.array(*map(F.lit, (0.4, 0.4, 0.2)))
    assert one(spark, arrays.argmax(b))[0] == 0
    merged = arrays.group_max(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))), {0: 0, 1: 1, 2: 1, 3: 2}, 3)
    assert one(spark, merged)[0] == [0.1, 0.3, 0.4]


def test_codes_and_remaps(spark):
    codes = spark.createDataFrame([(0,), (1,), (2,), (11,)], "c int")
    assert [tuple(r) for r in codes.select(raster.gt_offset(F.col("c")), raster.gt_offset(F.col("c"), True)).collect()] == [(-1, 0), (-1, 0), (0, 0), (9, 9)]
    with pytest.raises(Exception, match="unmapped"):
        one(spark, taxonomy.remap_strict(F.lit(77), {0: 0}))
    assert one(spark, taxonomy.remap_keeping(F.lit(77), {0: 0}))[0] == 77
    with pytest.raises(ValueError):
        taxonomy.index_map({0: "a"}, {}, {})


def test_mosaic_takes_zero_for_empty(spark):
    t = spark.createDataFrame([(1, 0, 0), (1, 1, 5), (1, 2, 7), (2, 0, 0)], "cell int, o int, v int")
    assert {r["cell"]: r["v"] for r in raster.mosaic_first(t, ["cell"], "v", F.col("o")).collect()} == {1: 5, 2: 0}


def test_pixel_formulas(spark):
    assert one(spark, arrays.ndvi(F.lit(0.6), F.lit(0.2)))[0] == pytest.approx(1.5, abs=1e-6)
    assert one(spark, arrays.ndvi(F.lit(10), F.lit(20), True))[0] == 2.0  # 246 / 30 + 1, clipped
    r = one(spark, geometry.euler_zyx(F.lit(0.0), F.lit(0.0), F.lit(2**-0.5), F.lit(2**-0.5)).alias("e"))["e"]
    assert (r["yaw"], r["pitch"], r["roll"]) == pytest.approx((90, 0, 0), abs=1e-6)
    for x, y, want in ((2.3, 7.9, (2, 2)), (-5.0, 100.0, (0, 0))):
        c = one(spark, geometry.cell(F.lit(x), F.lit(y), 0, 10, 1, 10, 10).alias("c"))["c"]
        assert (c["row"], c["col"]) == want
    assert [r[0] for r in spark.range(3).select(geometry.power_spacing(F.col("id"), 3, 0, 8, 3)).collect()] == [0, 1, 8]
    assert geometry.world_grid(spark).agg(F.max("y")).first()[0] == pytest.approx(6250)


def test_utm_of_a_known_point(spark):
    u = one(spark, geometry.utm(F.lit(0.0), F.lit(-87.0), 32616).alias("u"))["u"]
    assert (u["x"], u["y"]) == pytest.approx((500000, 0), abs=1e-6)
    u = one(spark, geometry.utm(F.lit(45.0), F.lit(-84.0), 32616).alias("u"))["u"]
    assert (u["x"], u["y"]) == pytest.approx((736450, 4987329), abs=300)


def test_jitter_names(spark):
    rows = spark.createDataFrame([("0.0_0.0_0.0",), ("0.0_5.0_0.0",), ("20.0_0.0_0.0",), ("1.0_1.0_0.0",)], "n string").select("n", text.jitter(F.col("n")).alias("j")).select("n", "j.*")
    kept = {r["n"]: (r["jitter_type"], r["jitter"]) for r in relational.without_wide_jitter(rows).collect()}
    assert kept == {"0.0_0.0_0.0": ("imu", 0.0), "0.0_5.0_0.0": ("altitude", 5.0), "1.0_1.0_0.0": (None, None)}


def test_tile_starts_repeat_at_the_edge():
    assert raster.tile_starts(5000, 2000) == [0, 1500, 3000, 3000]
    assert raster.tile_starts(5200, 2000) == [0, 1500, 3000, 3200]
    assert raster.tile_starts(2000, 2000) == [0, 0]
    assert raster.tile_starts(1999, 2000) == []


def test_blend_of_a_constant_is_constant(spark):
    px = spark.range(40 * 40).select(F.floor(F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), F.lit(0.25).alias("v"))
    out = raster.blended(raster.in_patches(px, 40, 40, 16, 12), [], "v", 16, 12)
    assert out.count() == 1600 and out.agg(F.max(F.abs(F.col("v") - 0.25))).first()[0] < 1e-12


def test_border_fill_of_an_image_of_holes(spark):
    px = spark.createDataFrame([(0, 0, 0, 255), (0, 0, 1, 255), (1, 0, 0, 255), (1, 0, 1, 4)], "image int, row int, col int, label int")
    got = {(r["image"], r["col"]): r["label"] for r in raster.border_mode_fill(px, ["image"], "label").collect()}
    assert got == {(0, 0): None, (0, 1): None, (1, 0): 4, (1, 1): 4}


def test_weights(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 10)], "k string, n long")
    assert {r["k"]: r["weight"] for r in metrics.inverse_frequency_weights(counts).collect()} == {"a": 1.0, "b": 2.0, "c": 10.0}


def test_metrics_files(spark, tmp_path):
    folder = tmp_path / "common" / "slic" / "dw" / "dem" / "1.0" / "none" / "place" / "flight1"
    folder.mkdir(parents=True)
    (folder / "metrics.txt").write_text("water: 0.5\nland, trees: 0.25\nmIoU: 0.375\n")
    r = tables.read_metrics(spark, str(tmp_path), tables.RUN_DIMENSIONS).first()
    assert (r["label_set"], r["res"], r["trajectory"], r["miou"]) == ("common", "1.0", "flight1", 0.375)
    assert [tuple(c) for c in r["classes"]] == [("water", 0.5), ("land, trees", 0.25)]
    ious = spark.createDataFrame([("r", 1, "land, trees", 0.25), ("r", 0, "water", 0.5)], "run string, idx int, names string, iou double")
    assert tables.metrics_text(ious, ["run"]).first()["value"] == "water: 0.5\nland, trees: 0.25\nmIoU: 0.375"


def test_headed_csv(spark, tmp_path):
    path = tmp_path / "aligned.csv"
    path.write_text("made by hand\n\nimage, lat ,lon\n images/a.png , 1.5,2\nb.png,3,4\n")
    rows = tables.read_headed_csv(spark, str(path), "image", tables.header_columns("image, lat ,lon")).orderBy("image").collect()
    assert [tuple(r) for r in rows] == [("b.png", "3", "4"), ("images/a.png", "1.5", "2")]


def test_manifest_and_geojson_and_logs(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b")], "img_path string, label_path string")
    tables.write_manifest(pairs, str(tmp_path / "m"))
    tables.write_manifest(pairs.union(pairs), str(tmp_path / "m"))  # an existing file stays
    assert tables.read_manifest(spark, str(tmp_path / "m")).collect() == pairs.collect()
    ring = one(spark, tables.first_polygon(F.lit('{"features":[{"geometry":{"coordinates":[[[1,2],[3,4]]]}}]}')))[0]
    assert ring == [[1.0, 2.0], [3.0, 4.0]]
    logs = spark.createDataFrame([("f", 0, "mIoU: tensor(0.5)"), ("f", 1, "mIoU: 0.75 done"), ("g", 0, "none")], "file string, n int, line string")
    got = {r["file"]: (r["miou"], r["water"]) for r in tables.parse_logs(logs, {"miou": "mIoU", "water": "water"}).collect()}
    assert got == {"f": (0.75, None), "g": (None, None)}


def test_regions_against_flood_fill(spark):
    rng = np.random.default_rng(0)
    grid = rng.integers(0, 2, (12, 12))
    px = spark.createDataFrame([(0, r, c, int(grid[r, c])) for r in range(12) for c in range(12)], "image int, row int, col int, label int")
    got = {(r["row"], r["col"]): r["region"] for r in components.regions(px, ["image"], "label", 12, 12).collect()}
    for r in range(12):
        for c in range(12):
            seen, todo = {(r, c)}, [(r, c)]
            while todo:
                i, j = todo.pop()
                for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if n not in seen and 0 <= n[0] < 12 and 0 <= n[1] < 12 and grid[n] == grid[r, c]:
                        seen.add(n)
                        todo.append(n)
            assert got[r, c] == min(i * 12 + j for i, j in seen)


def test_mean_field_is_a_distribution_and_smooths():
    places = np.array([[i, j] for i in range(5) for j in range(5)], float)
    probs = np.tile([0.9, 0.1], (25, 1))
    probs[12] = [0.4, 0.6]
    q = small_crf.mean_field(-np.log(probs + 1e-3), places, np.zeros((25, 1)), (20, 5, 3), (3, 5), 5)
    assert np.allclose(q.sum(1), 1) and q.argmax(1).max() == 0


def test_noise_is_seeded_and_normal(spark):
    rows = spark.range(20000).select(experiments.noise(F.lit(2.0), F.col("id"), seed=3).alias("e"))
    r = rows.agg(F.avg("e"), F.stddev("e")).first()
    assert abs(r[0]) < 0.06 and abs(r[1] - 2) < 0.05
    assert rows.repartition(7).agg(F.max("e")).first() == rows.agg(F.max("e")).first()


def test_confusion_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (9, 0)], "gt int, pred int")
    rows.write.parquet(str(tmp_path / "in"))
    q = incremental.confusion_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), [], 2)
    s = q.writeStream.outputMode("complete").format("memory").queryName("cm_stream").start()
    s.processAllAvailable()
    s.stop()
    assert {tuple(r) for r in spark.table("cm_stream").collect()} == {(0, 0, 1), (0, 1, 1), (1, 1, 1)}


def test_unavailable_sources_say_so():
    with pytest.raises(NotImplementedError, match="downloading"):
        tables.download("x")
    assert rasters.image is not None


def test_headed_csvs_with_headers_on_lines_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("junk\nimage,lat\na.png,1\n")
    (tmp_path / "b.csv").write_text("junk\njunk, more\n\nimage,lat\nb.png,2\n")
    rows = tables.read_headed_csv(spark, str(tmp_path), "image", ["image", "lat"]).orderBy("image").collect()
    assert [tuple(r) for r in rows] == [("a.png", "1"), ("b.png", "2")]
    (tmp_path / "c.csv").write_text("no header here\n1,2\n")
    with pytest.raises(Exception, match="no line with"):
        tables.read_headed_csv(spark, str(tmp_path), "image", ["image", "lat"]).collect()


def test_null_keys_are_groups(spark):
    rows = spark.createDataFrame([(None, 1, 5.0), (None, 1, 7.0), (1, 2, 3.0)], "k int, label int, v double")
    assert sorted((r["vote"] for r in metrics.segment_vote(rows, ["k"], "label").collect())) == [1, 1, 2]
    assert [r["group_count"] for r in metrics.group_stats(rows, ["k"], "v").orderBy("v").collect()] == [1, 2, 2]
    assert relational.latched(rows, ["k"], "v", ["v"], "first").where("k IS NULL AND first = 5").count() == 2
    assert raster.clean_elevation(rows, ["k"], "v").count() == raster.min_max_8bit(rows, ["k"], "v").count() == 3


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    parts = {"even": rng.uniform(-5, 5, 3000), "ties": np.repeat([1.0, 2.0], 500), "one": np.array([7.0]), "wild": 10.0 ** rng.uniform(-12, 12, 2500), "same": np.zeros(40)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in parts.items() for v in vs] + [("even", None)], "k string, v double")
    for p in (0.0, 0.5, 0.999, 1.0):
        got = {r["k"]: r["p"] for r in metrics.exact_percentile(rows, ["k"], "v", p, "p", bins=16).collect()}
        assert got == pytest.approx({k: np.quantile(v, p) for k, v in parts.items()})
    whole = metrics.exact_percentile(rows.where("k = 'even'"), [], "v", 0.25, "p").first()["p"]
    assert whole == pytest.approx(np.quantile(parts["even"], 0.25))


def test_focal_over_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(raster, "FOCAL_BLOCK", 5)
    rng = np.random.default_rng(5)
    cells = {(r, c): float(rng.integers(0, 50)) for r in range(13) for c in range(11) if rng.random() < 0.8}
    px = spark.createDataFrame([(0, r, c, v) for (r, c), v in cells.items()], "image int, row int, col int, v double")
    around = lambda r, c: [cells.get((r + i, c + j)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    low = {(r["row"], r["col"]): r["v"] for r in raster.focal(px, ["image"], "v", raster.box(1), F.array_min).collect()}
    assert low == {k: min(v for v in around(*k) if v is not None) for k in cells}
    mid = {(r["row"], r["col"]): r["v"] for r in raster.median(px, ["image"], "v", 1).collect()}
    assert mid == {k: sorted(v or 0.0 for v in around(*k))[4] for k in cells}


def test_boundary_bits_equal_class_by_class(spark):
    rng = np.random.default_rng(6)
    px = spark.createDataFrame([(0, r, c, int(rng.integers(-1, 3)), int(rng.integers(0, 3))) for r in range(9) for c in range(9)], "image int, row int, col int, g int, p int")
    bits = {tuple(r) for r in raster.boundary_sums(px, ["image"], "g", "p", [0, 1, 2]).collect()}
    hard = px.withColumn("probs", F.array(*[(F.col("p") == k).cast("double") for k in range(3)]))
    assert bits == {tuple(r) for r in raster.soft_boundary_sums(hard, ["image"], "g", "probs", [0, 1, 2]).collect()}


def test_regions_over_the_borders_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4)
    grid = [[1] * 11, [0] * 10 + [1], [1] * 11, [1] + [0] * 10, [1] * 11]  # a snake of ones
    px = spark.createDataFrame([(k, r, c, grid[r][c]) for k in (0, 1) for r in range(5) for c in range(11)], "image int, row int, col int, label int")
    got = {(r["image"], r["row"], r["col"]): r["region"] for r in components.regions(px, ["image"], "label", 5, 11).collect()}
    assert got == {(k, r, c): 0 if grid[r][c] else 11 * r + (r == 3) for k in (0, 1) for r in range(5) for c in range(11)}


def test_crf_in_patches_against_patch_by_patch(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([1, 1, 1], (10, 9))
    f = rng.random((10, 9))
    px = spark.createDataFrame([(0, r, c, p[r, c].tolist(), [float(f[r, c])]) for r in range(10) for c in range(9)], "image int, row int, col int, probs array<double>, features array<double>")
    got = {(r["row"], r["col"]): (r["label"], r["prob"]) for r in small_crf.refined_in_patches(px, ["image"], 10, 9, 3, 6, 4).collect()}
    total, weight = np.zeros((10, 9, 3)), np.zeros((10, 9, 1))
    ramp = lambda x: (1 - max(0, x - 3) / 3) * (1 - max(0, 2 - x) / 3)
    for a in (0, 4):
        for b in (0, 4):
            at = [(i, j) for i in range(a, min(a + 6, 10)) for j in range(b, min(b + 6, 9))]
            q = small_crf.mean_field(-np.log(np.array([p[k] for k in at]) + 1e-3), np.array(at, float), np.array([[f[k]] for k in at]), (20.0, 5.0, 3.0), (3.0, 5.0), 5)
            for (i, j), row in zip(at, q):
                w = ramp(i - a) * ramp(j - b)
                total[i, j] += w * row
                weight[i, j] += w
    want = total / weight
    assert all(got[k] == (want[k].argmax(), pytest.approx(want[k].max())) for k in got) and len(got) == 90


def test_matrix_files(spark, tmp_path):
    c = cm(spark, [[3, 1], [0, 4]], [[0, 0], [2, 0]])
    for r in tables.matrix_files(c, ["run"], 2).collect():
        (tmp_path / f"{r['run']}.npy").write_bytes(bytes(r["content"]))
    assert np.load(tmp_path / "0.npy").tolist() == [[3, 1], [0, 4]]
    got = {(r["file"][-5], r["gt"], r["pred"], r["n"]) for r in tables.read_matrices(spark, str(tmp_path)).collect()}
    assert got == {("0", 0, 0, 3), ("0", 0, 1, 1), ("0", 1, 1, 4), ("1", 1, 0, 2)}


def test_checks_fail_when_read(spark):
    meta = spark.createDataFrame([("s", "EPSG:1", 3), ("s", "EPSG:1", 4), ("t", "EPSG:2", 5)], "folder string, crs string, bands int")
    assert relational.uniform_or_error(meta, ["folder"], ["crs"]).count() == 3
    with pytest.raises(Exception, match="one bands in a set"):
        relational.uniform_or_error(meta, ["folder"], ["crs", "bands"]).collect()
    assert relational.asserted(meta, {"bands": F.col("bands") > 2}).count() == 3
    with pytest.raises(Exception, match="check failed: few bands"):
        relational.asserted(meta, {"bands": F.col("bands") > 2, "few bands": F.col("bands") < 5}).collect()
    assert one(spark, geometry.at_place(F.lit("a"), {"a": 2.5}))[0] == 2.5
    with pytest.raises(Exception, match="no value for place b"):
        one(spark, geometry.at_place(F.lit("b"), {"a": 2.5}))


def test_layers_may_be_missing(spark):
    base = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int")
    nir = spark.createDataFrame([(0, 1, 9.0)], "row int, col int, value double")
    got = relational.aligned_layers(base, {"nir": nir, "dsm": None}, ["row", "col"]).orderBy("col").collect()
    assert [tuple(r) for r in got] == [(0, 0, None, None), (0, 1, 9.0, None)]


def test_places_bounds_and_triangles(spark):
    p = one(spark, geometry.placed(F.lit(2.0), F.lit(1.0), F.lit(np.pi / 2), F.lit(10.0), F.lit(20.0)).alias("p"))["p"]
    assert (p["x"], p["y"]) == pytest.approx((9, 22))
    b = one(spark, geometry.utm_bounds(F.lit(44.0), F.lit(-88.0), F.lit(45.0), F.lit(-86.0), 32616).alias("b"))["b"]
    low = one(spark, geometry.utm(F.lit(44.0), F.lit(-87.0), 32616).alias("u"))["u"]
    west = one(spark, geometry.utm(F.lit(44.0), F.lit(-88.0), 32616).alias("u"))["u"]
    assert b["y0"] == pytest.approx(low["y"], abs=1e-3) and b["x0"] == pytest.approx(west["x"], abs=1e-3)
    t = geometry.grid_triangles(spark, 3, 2).orderBy("triangle").collect()
    assert [tuple(r) for r in t] == [(0, 0, 1, 2), (1, 1, 3, 2), (2, 2, 3, 4), (3, 3, 5, 4)]


def test_cubic_keeps_planes_and_warps_find_cells(spark):
    px = spark.createDataFrame([(r, c, 2.0 * r + c) for r in range(12) for c in range(12)], "row int, col int, v double")
    got = {(r["row"], r["col"]): r["v"] for r in resample.resampled(px, [], "v", (12, 12), (24, 24), "cubic").collect()}
    assert len(got) == 576 and all(got[r, c] == pytest.approx(2 * ((r + 0.5) / 2 - 0.5) + (c + 0.5) / 2 - 0.5) for r in range(4, 20) for c in range(4, 20))
    asked = spark.createDataFrame([(1, 2.3, 7.9), (2, -1.0, 3.0)], "id int, x double, y double")
    assert {r["id"]: r["v"] for r in resample.warped(px, [], "v", asked, 0.0, 10.0, 1.0, 12, 12).collect()} == {1: 6.0, 2: None}


def test_mirrored_patches_blend_to_the_image(spark):
    px = spark.createDataFrame([(r, c, float(r * 7 + c)) for r in range(10) for c in range(7)], "row int, col int, v double")
    wide = raster.mirrored(px, 10, 7, 6, 4)
    assert {(r["row"], r["col"]): r["v"] for r in wide.collect()} == {
        (r, c): float((r if r < 10 else 19 - r) * 7 + (c if c < 7 else 13 - c)) for r in range(10) for c in range(10)
    }
    back = raster.cropped(raster.blended(raster.in_patches(wide, 10, 10, 6, 4), [], "v", 6, 4), (0, 10), (0, 7))
    assert {(r["row"], r["col"]): r["v"] for r in back.collect()} == pytest.approx({(r["row"], r["col"]): r["v"] for r in px.collect()})


def test_colours_and_order(spark):
    a, b = (one(spark, text.random_rgb(3, F.lit(k)).alias("c"))["c"] for k in (1, 2))
    assert a != b and all(0 <= x <= 255 for x in a + b) and a == one(spark, text.random_rgb(3, F.lit(1)).alias("c"))["c"]
    rows = spark.createDataFrame([("a",), ("b",), ("z",)], "k string")
    assert [r["k"] for r in relational.in_category_order(rows, "k", ["b", "a"], descending=True).collect()] == ["z", "a", "b"]
