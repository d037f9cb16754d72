"""Raster files: codings of other writers, pixels there and back, several tasks for a file, nothing left of a failed write."""

import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelgrid.operators import tables
from labelgrid.sources import png, rasters, tiff
from labelgrid.sources import tables as sources


def lzw(raw):
    """LZW as TIFF has it, kept simple: nine bits, and a clear code before a tenth is needed."""
    codes = []
    for at in range(0, len(raw), 200):
        codes += [256, *raw[at : at + 200]]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))


def other_tiff(image, order="<", big=False, compression=1, predictor=1, separate=False, strip=3):
    """A TIFF of strips, as another writer would make it."""
    h, w, bands = image.shape
    size = image.dtype.itemsize
    blobs = []
    for plane in [image[:, :, k : k + 1] for k in range(bands)] if separate else [image]:
        for top in range(0, h, strip):
            block = plane[top : top + strip]
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                rows = np.frombuffer(block.astype(f">f{size}").tobytes(), np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1).reshape(len(block), -1)
                step = block.shape[2]
                rows = np.concatenate([rows[:, :step], rows[:, step:] - rows[:, :-step]], axis=1)
                raw = rows.tobytes()
            blobs.append({1: lambda x: x, 5: lzw, 8: zlib.compress}[compression](raw))
    start = 16 if big else 8
    offsets = [start + sum(map(len, blobs[:k])) for k in range(len(blobs))]
    at = start + sum(map(len, blobs))
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    many, place = (16, "Q") if big else (4, "I")
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * size] * bands), (259, 3, [compression]), (273, many, offsets), (277, 3, [bands]), (278, 4, [strip]),
            (279, many, [len(b) for b in blobs]), (284, 3, [2 if separate else 1]), (317, 3, [predictor]), (339, 3, [form] * bands), (33550, 12, [2.0, 3.0, 0.0]), (33922, 12, [1.0, 1.0, 0.0, 10.0, 20.0, 0.0])]
    slot = struct.calcsize("<" + place)
    after = at + (8 if big else 2) + (20 if big else 12) * len(tags) + slot
    entries, beyond = b"", b""
    for tag, kind, values in tags:
        value = struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[kind] * len(values), *values)
        if len(value) > slot:
            value, beyond = struct.pack(order + place, after + len(beyond)), beyond + value
        entries += struct.pack(order + "HH" + place, tag, kind, len(values)) + value.ljust(slot, b"\0")
    head = struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)
    return {"<": b"II", ">": b"MM"}[order] + head + b"".join(blobs) + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * slot + beyond


@pytest.mark.parametrize("how", [
    {}, {"order": ">"}, {"big": True}, {"separate": True, "compression": 8}, {"compression": 5}, {"compression": 8, "predictor": 2}, {"order": ">", "compression": 8, "predictor": 2},
])
@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_tiffs_of_other_writers(how, kind):
    if how.get("predictor") == 2 and kind.startswith("f"):
        how = {**how, "predictor": 3}
    image = (np.random.default_rng(1).random((8, 11, 3)) * 250).astype(kind)
    raw = other_tiff(image, **how)
    of = tiff.layout(lambda at, n: raw[at : at + n])
    assert (of.width, of.height, of.bands, of.x0, of.y0, of.dx, of.dy) == (11, 8, 3, 8.0, 23.0, 2.0, 3.0)
    out = np.zeros((3 if of.separate else 1, 8, 11, 1 if of.separate else 3), kind)
    blocks = of.across * of.down
    for k in range(len(of.offsets)):
        row, col, h, w = of.place(k % blocks)
        out[k // blocks, row : row + h, col : col + w] = tiff.decoded(of, raw[of.offsets[k] : of.offsets[k] + of.sizes[k]], k % blocks)
    assert np.array_equal(np.concatenate(list(out), axis=2), image)


def test_long_lzw():
    """Codes of all widths, by an encoder that follows the specification's steps."""
    raw = bytes(np.random.default_rng(2).integers(0, 7, 30000, np.uint8))
    table, codes, word = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    width, following = 9, 258
    for byte in raw:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        codes.append((table[word], width))
        table[word + bytes([byte])] = following
        following += 1
        width = 12 if following >= 2048 else 11 if following >= 1024 else 10 if following >= 512 else 9
        if following == 4094:
            codes.append((256, width))
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = bytes([byte])
    codes += [(table[word], width), (257, width)]
    bits = "".join(f"{c:0{n}b}" for c, n in codes)
    assert tiff._lzw(bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8)))[: len(raw)] == raw


@pytest.mark.parametrize("samples, bits", [(1, 8), (3, 8), (4, 16)])
def test_png_filters(samples, bits):
    rng = np.random.default_rng(samples)
    image = rng.integers(0, 1 << bits, (11, 9, samples)).astype(f">u{bits // 8}")
    step, lines, above = samples * bits // 8, b"", np.zeros(9 * samples * bits // 8, int)
    for r, row in enumerate(image):
        x = np.frombuffer(row.tobytes(), np.uint8).astype(int)
        left, corner = (np.concatenate([np.zeros(step, int), v[:-step]]) for v in (x, above))
        p = left + above - corner
        d = [abs(p - v) for v in (left, above, corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][r % 5]
        lines += bytes([r % 5]) + ((x - guess) % 256).astype(np.uint8).tobytes()
        above = x
    colour = {1: 0, 3: 2, 4: 6}[samples]
    body = zlib.compress(lines)
    raw = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 11, bits, colour, 0, 0, 0)) + png._chunk(b"IDAT", body[:50]) + png._chunk(b"IDAT", body[50:]) + png._chunk(b"IEND", b"")
    assert np.array_equal(png.decoded(raw), image)


def pixels(spark, image, file="a/one.tif"):
    h, w, bands = image.shape
    rows = [(file, r, c, *[float(v) for v in image[r, c]]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, ["file", "row", "col", *[f"v{k}" for k in range(bands)]]).repartition(5)


def layouts(spark, h, w, file="a/one.tif"):
    return spark.createDataFrame([(file, w, h, 4326, 1.0, 2.0, 0.5, 0.25)], "file string, width int, height int, epsg int, x0 double, y0 double, dx double, dy double")


def array(df, h, w, bands):
    out = np.full((h, w, bands), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = [r[f"b{k + 1}"] for k in range(bands)]
    return out


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32"])
def test_geotiff_there_and_back(spark, tmp_path, kind):
    image = (np.random.default_rng(3).random((300, 270, 2)) * 200).astype(kind)
    rasters.write_geotiff(pixels(spark, image), layouts(spark, 300, 270), str(tmp_path), ["v0", "v1"], kind)
    assert os.listdir(tmp_path) == ["a"] and os.listdir(tmp_path / "a") == ["one.tif"]
    back = rasters.read_geotiff(spark, str(tmp_path), task=20000)
    assert back.rdd.getNumPartitions() > 2
    assert np.array_equal(array(back, 300, 270, 2), image)
    one = rasters.read_geotiff(spark, str(tmp_path), bands=[2], window=(250, 100, 260, 268))
    assert one.columns == ["file", "row", "col", "b2"]
    assert {(r["row"], r["col"]): r["b2"] for r in one.collect()} == {(r, c): image[r, c, 1] for r in range(250, 260) for c in range(100, 268)}
    of = rasters.read_layouts(spark, f"file://{tmp_path}").first()
    assert (of["width"], of["height"], of["bands"], of["dtype"], of["epsg"], of["x0"], of["dy"]) == (270, 300, 2, kind, 4326, 1.0, 0.25)


def test_absent_pixels_and_failed_writes(spark, tmp_path):
    few = spark.createDataFrame([("x.tif", 0, 1, 5.0), ("x.tif", 2, 0, None), ("x.tif", 9, 9, 1.0)], "file string, row int, col int, v double")
    of = layouts(spark, 3, 2, "x.tif").unionByName(layouts(spark, 1, 1, "y.tif"))
    rasters.write_geotiff(few, of, str(tmp_path / "ok"), ["v"], "int16", -1)
    got = {(r["file"][-5:], r["row"], r["col"]): r["b1"] for r in rasters.read_geotiff(spark, str(tmp_path / "ok"), masked=True).collect()}
    assert got == {("x.tif", r, c): 5 if (r, c) == (0, 1) else None for r in range(3) for c in range(2)} | {("y.tif", 0, 0): None}
    bad = few.withColumn("v", F.when(F.col("row") == 0, F.raise_error(F.lit("no pixel"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no pixel"):
        rasters.write_geotiff(bad, of, str(tmp_path / "bad"), ["v"], "int16", -1)
    assert not os.path.exists(tmp_path / "bad") or not os.listdir(tmp_path / "bad")


def test_png_there_and_back(spark, tmp_path):
    image = np.random.default_rng(4).integers(0, 256, (60, 40, 3))
    rasters.write_png(pixels(spark, image, "m.png").where("row <> 7 OR col = 39"), str(tmp_path), ["v0", "v1", "v2"])
    image[7, :39] = 0
    assert np.array_equal(array(rasters.read_png(spark, str(tmp_path)), 60, 40, 3), image)


def test_a_large_headed_csv_is_read_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = [(f"a{k}.png", f"x, {k}", str(k)) for k in range(2000)]
        (tmp_path / "big.csv").write_text("junk, a\n" * 300 + "image,note,n\n" + "".join(f'{a}, "{b}" ,{c}\n' for a, b, c in rows) + "image again,,\n")
        out = sources.read_headed_csv(spark, str(tmp_path), "image", ["image", "note", "n"])
        assert sorted(map(tuple, out.collect())) == sorted([*rows, ("image again", None, None)])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_built_tables_are_found_again(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    runs = []

    def build():
        runs.append(1)
        return spark.read.parquet(str(tmp_path / "in")).selectExpr("sum(id) AS total")

    get = lambda **how: tables.built(spark.newSession(), "sum", [str(tmp_path / "in")], build, **how).first()["total"]
    assert [get(), get()] == [10, 10] and len(runs) == 1
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert get() == 13 and len(runs) == 2
    assert get(version="2") == 13 and len(runs) == 3
    time.sleep(1.1)
    assert tables.remove_older(spark, 1) >= 3 and get() == 13 and len(runs) == 4
