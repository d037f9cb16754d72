"""Raster files as Spark tables of pixels: the formats `geotiff` and `png`, read and written.

A read gives (file, row, col, b1, b2, …). A GeoTIFF is cut to runs of its strips or tiles, so one file is read by as
many tasks as its size asks for, and each task decodes a block at a time; small files share a task. A schema
given to the reader names the bands that are decoded, and a window the blocks that are read at all.

A write sorts the pixels to blocks on the executors, compresses each block there, and lets one task put a file
together block by block; files appear when the whole write has ended.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from . import png, tiff

TIFF_FILES, PNG_FILES = ("*.tif", "*.tiff", "*.TIF", "*.TIFF"), ("*.png", "*.PNG")
#: Bytes of files that one task reads, and pixels of a tile that is written.
TASK, TILE = 16 << 20, 256

_SPARK = {"u1": IntegerType(), "u2": IntegerType(), "i1": IntegerType(), "i2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "i8": LongType(), "f4": FloatType(), "f8": DoubleType()}
_ARROW = {IntegerType(): pa.int32(), LongType(): pa.int64(), FloatType(): pa.float32(), DoubleType(): pa.float64()}
_HEAD = [StructField("file", StringType()), StructField("row", IntegerType()), StructField("col", IntegerType())]


# Files


def _store(path: str):
    """The file system that a path or URI is in, and the path there."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str, patterns: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files under path, or of path itself, whose names match one of the patterns, in order of path."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    named = [f for f in found if f.is_file and any(fnmatch.fnmatchcase(f.base_name, p) for p in patterns) and "/_writing-" not in f.path]
    return sorted((f.path, f.size) for f in named)


class _Ranges:
    def __init__(self, store, path: str):
        self.file = store.open_input_file(path)

    def __enter__(self):
        return lambda at, n: self.file.read_at(n, at)

    def __exit__(self, *_):
        self.file.close()


def _window(options) -> tuple[int, int, int, int]:
    """First row, first column, end row and end column of the option window, or of everything."""
    return tuple(map(int, options["window"].split(","))) if options.get("window") else (0, 0, 1 << 31, 1 << 31)


# Reading


class _Share(InputPartition):
    """Some of a file's blocks, the part-th of parts, or some whole files."""

    def __init__(self, names: list[str], part: int = 0, parts: int = 1):
        self.names, self.part, self.parts = names, part, parts


class _Pixels(DataSourceReader):
    def __init__(self, source: _Raster, schema: StructType):
        self.path, self.options, self.schema, self.patterns, self.splits = source.path, dict(source.options), schema, source.patterns, source.splits
        self.bands = [int(c[1:]) - 1 for c in schema.names if re.fullmatch(r"b[0-9]+", c)]
        self.masked = source.options.get("masked") == "true"

    def partitions(self) -> list[_Share]:
        size = int(self.options.get("task", TASK))
        out, small, held = [], [], 0
        for name, n in files(self.path, self.patterns):
            if self.splits and n > size:
                parts = -(-n // size)
                out += [_Share([name], k, parts) for k in range(parts)]
                continue
            if small and held + n > size:
                out.append(_Share(small))
                small, held = [], 0
            small.append(name)
            held += n
        return [*out, *([_Share(small)] if small else [])]

    def batch(self, name: str, block: np.ndarray, row: int, col: int, nodata: float | None) -> pa.RecordBatch | None:
        """The pixels of a block of the bands wanted, whose corner is at row and col, inside the window."""
        r0, c0, r1, c1 = _window(self.options)
        a, b = max(r0 - row, 0), max(c0 - col, 0)
        block = block[a : max(r1 - row, 0), b : max(c1 - col, 0)]
        height, width = block.shape[:2]
        if not height or not width:
            return None
        columns, k = [], 0
        for field in self.schema.fields:
            if field.name == "file":
                columns.append(pa.array([name] * (height * width), pa.string()))
            elif field.name == "row":
                columns.append(pa.array(np.repeat(np.arange(row + a, row + a + height, dtype=np.int32), width)))
            elif field.name == "col":
                columns.append(pa.array(np.tile(np.arange(col + b, col + b + width, dtype=np.int32), height)))
            else:
                kind = _ARROW[field.dataType]
                v = block[:, :, k].reshape(-1)
                none = (np.isnan(v) if nodata != nodata else v == nodata) if self.masked and nodata is not None else None
                columns.append(pa.array(v.astype(kind.to_pandas_dtype()), kind, mask=none))
                k += 1
        return pa.RecordBatch.from_arrays(columns, self.schema.names)


class _TiffPixels(_Pixels):
    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        r0, c0, r1, c1 = _window(self.options)
        for name in partition.names:
            with _Ranges(store, name) as read_at:
                of = tiff.layout(read_at)
                if self.bands and max(self.bands) >= of.bands:
                    raise ValueError(f"{name} has {of.bands} bands")
                blocks = of.across * of.down
                for k in range(blocks * partition.part // partition.parts, blocks * (partition.part + 1) // partition.parts):
                    row, col, height, width = of.place(k)
                    if row >= r1 or row + height <= r0 or col >= c1 or col + width <= c0:
                        continue
                    raw = lambda at: read_at(of.offsets[at], of.sizes[at])
                    if of.separate:
                        planes = [tiff.decoded(of, raw(b * blocks + k), k) for b in self.bands]
                        block = np.concatenate(planes, axis=2) if planes else np.zeros((height, width, 0))
                    elif self.bands:
                        block = tiff.decoded(of, raw(k), k)[:, :, self.bands]
                    else:
                        block = np.zeros((height, width, 0))
                    if (out := self.batch(name, block, row, col, of.nodata)) is not None:
                        yield out


class _PngPixels(_Pixels):
    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for name in partition.names:
            with store.open_input_stream(name) as f:
                image = png.decoded(f.read())
            if self.bands and max(self.bands) >= image.shape[2]:
                raise ValueError(f"{name} has {image.shape[2]} bands")
            for row in range(0, len(image), TILE):
                if (out := self.batch(name, image[row : row + TILE][:, :, self.bands], row, 0, None)) is not None:
                    yield out


class _Layouts(DataSourceReader):
    """A row for each file, from its header alone."""

    def __init__(self, source: _Raster):
        self.path, self.patterns = source.path, source.patterns

    def partitions(self) -> list[_Share]:
        names = [n for n, _ in files(self.path, self.patterns)]
        return [_Share(names[k : k + 256]) for k in range(0, len(names), 256)]

    def read(self, partition: _Share) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for name in partition.names:
            with _Ranges(store, name) as read_at:
                of = tiff.layout(read_at)
            yield name, of.width, of.height, of.bands, of.dtype.name, of.nodata, of.epsg, of.x0, of.y0, of.dx, of.dy


LAYOUT = "file string, width int, height int, bands int, dtype string, nodata double, epsg int, x0 double, y0 double, dx double, dy double"


class _Raster(DataSource):
    patterns: tuple[str, ...] = ()
    splits = False

    @property
    def path(self) -> str:
        return self.options["path"]

    def _first(self) -> str:
        for name, _ in files(self.path, self.patterns):
            return name
        raise FileNotFoundError(f"no {' or '.join(self.patterns)} under {self.path}")


class GeoTiff(_Raster):
    """The format geotiff. Options: window (first row, first column, end row, end column), masked (no-data as null), task (bytes a task reads), what=layout (a row for each file)."""

    patterns, splits = TIFF_FILES, True

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> StructType | str:
        if self.options.get("what") == "layout":
            return LAYOUT
        with _Ranges(_store(self.path)[0], self._first()) as read_at:
            of = tiff.layout(read_at)
        return StructType([*_HEAD, *[StructField(f"b{k + 1}", _SPARK[of.dtype.str[1:]]) for k in range(of.bands)]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Layouts(self) if self.options.get("what") == "layout" else _TiffPixels(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _TiffFiles(self.path)


class Png(_Raster):
    """The format png. Options: window, task, as those of geotiff."""

    patterns = PNG_FILES

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> StructType:
        with _store(self.path)[0].open_input_stream(self._first()) as f:
            _, _, _, colour = png.header(f.read(33))
        return StructType([*_HEAD, *[StructField(f"b{k + 1}", IntegerType()) for k in range(png.SAMPLES[colour])]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PngPixels(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _PngFiles(self.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)
    spark.dataSource.register(Png)


def _read(spark: SparkSession, kind: str, path: str, bands: list[int] | None, options: dict) -> DataFrame:
    register(spark)
    reader = spark.read.format(kind).options(**{k: v for k, v in options.items() if v is not None})
    if bands is None:
        return reader.load(path)
    whole = reader.load(path).schema
    return reader.schema(StructType([*_HEAD, *[whole[f"b{b}"] for b in bands]])).load(path)


def read_geotiff(spark: SparkSession, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, masked: bool = False, task: int | None = None) -> DataFrame:
    """(file, row, col, b1, …) of the GeoTIFFs under path; bands count from 1.

    All files have the bands of the first one at least; no-data values are left as they are unless masked.
    """
    return _read(spark, "geotiff", path, bands, {"window": window and ",".join(map(str, window)), "masked": "true" if masked else None, "task": task})


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, width, height, bands, dtype, nodata, epsg, x0, y0, dx, dy) of the GeoTIFFs under path."""
    register(spark)
    return spark.read.format("geotiff").option("what", "layout").load(path)


def read_png(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(file, row, col, b1, …) of the PNG images under path, of 8 or 16 bits; a palette's numbers stay numbers."""
    return _read(spark, "png", path, None, {"window": window and ",".join(map(str, window))})


# Writing


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Files(DataSourceArrowWriter):
    """Files that a task puts together under a name of their own, moved to their place when all tasks are done.

    Rows come file by file and in order.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _at(self, name: str) -> str:
        return f"{_store(self.path)[1]}/{name}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, top = _store(self.path)
        folder = f"{top}/_writing-{self.job}/{uuid.uuid4().hex}"
        names, out, now = [], None, None
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            at = columns["file"].to_pylist()
            edges = [0, *[k for k in range(1, len(at)) if at[k] != at[k - 1]], len(at)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if at[a] != now:
                    if out:
                        self.closed(out)
                        out.close()
                    now = at[a]
                    store.create_dir(f"{folder}/{now}".rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(f"{folder}/{now}")
                    names.append(f"{folder}\0{now}")
                    self.begun(out, {c: v[a].as_py() for c, v in columns.items() if c not in ("data", "rows")})
                self.some(out, {c: v.slice(a, b - a) for c, v in columns.items()})
        if out:
            self.closed(out)
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, top = _store(self.path)
        for folder, name in (x.split("\0") for m in messages if m for x in m.names):
            if "/" in name:
                store.create_dir(self._at(name).rpartition("/")[0], recursive=True)
            store.move(f"{folder}/{name}", self._at(name))
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, top = _store(self.path)
        folder = f"{top}/_writing-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class _TiffFiles(_Files):
    """Files of rows (file, block, data, total and what a Layout has)."""

    def begun(self, out, first: dict) -> None:
        self.first, self.sizes = first, []
        self.big = first["total"] > 4_000_000_000
        out.write(tiff.header((16 if self.big else 8) + first["total"], self.big))

    def some(self, out, rows: dict) -> None:
        for body in rows["data"]:
            raw = body.as_py()
            self.sizes.append(len(raw))
            out.write(raw)

    def closed(self, out) -> None:
        f, start = self.first, 16 if self.big else 8
        if sum(self.sizes) != f["total"] or len(self.sizes) != -(-f["width"] // TILE) * -(-f["height"] // TILE):
            raise ValueError(f"blocks of {f['file']} are missing")
        offsets = np.cumsum([start, *self.sizes])[:-1].tolist()
        geo = {k: f[k] for k in ("nodata", "epsg", "x0", "y0", "dx", "dy")}
        of = tiff.Layout(f["width"], f["height"], f["bands"], np.dtype(f["dtype"]), TILE, TILE, True, False, tiff.DEFLATE, 2, tuple(offsets), tuple(self.sizes), **geo)
        out.write(tiff.directory(of, start + f["total"], self.big))


class _PngFiles(_Files):
    """Files of rows (file, row, width, height, samples, data), in order of row."""

    def begun(self, out, first: dict) -> None:
        self.image, self.n = png.Writer(first["width"], first["height"], first["samples"]), 0
        out.write(self.image.head())

    def some(self, out, rows: dict) -> None:
        for body in rows["data"]:
            out.write(self.image.row(np.frombuffer(body.as_py(), np.uint8)))
            self.n += 1

    def closed(self, out) -> None:
        if self.n != self.image.height:
            raise ValueError("rows of an image are missing")
        out.write(self.image.end())


def write_geotiff(pixels: DataFrame, layouts: DataFrame, path: str, bands: list[str], dtype: str = "float32", nodata: float | None = None) -> None:
    """Writes pixels (file, row, col, bands) under path as tiled GeoTIFFs named as in file.

    layouts has a row (file, width, height, epsg, x0, y0, dx, dy) for each file, as read_layouts() gives; its number of bands, type
    and no-data are replaced by those given here. Pixels that are absent or null are nodata, or 0 where that
    is None. A tile is gathered and compressed in one task; a file is put together in one, a tile at a time.
    """
    spark = pixels.sparkSession
    register(spark)
    kind, fill = np.dtype(dtype), 0 if nodata is None else nodata
    geo = ["epsg", "x0", "y0", "dx", "dy"]
    places = layouts.select("file", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), *geo)
    across, down = (F.ceil(F.col(c) / TILE).cast("int") for c in ("width", "height"))
    block = (F.floor(F.col("row") / TILE) * F.ceil(F.col("width") / TILE) + F.floor(F.col("col") / TILE)).cast("long").alias("block")
    inside = pixels.join(places.select("file", "width", "height"), "file").where("row >= 0 AND col >= 0 AND row < height AND col < width")
    every = places.select("file", F.explode(F.sequence(F.lit(0).cast("long"), (across * down - 1).cast("long"))).alias("block"))

    def one(key, t):
        out = np.full((TILE, TILE, len(bands)), fill, kind)
        at = (t["row"].to_numpy() % TILE, t["col"].to_numpy() % TILE)
        for k, b in enumerate(bands):
            v = t[b].to_numpy(dtype=np.float64, na_value=np.nan)
            out[*at, k] = np.where(np.isnan(v), fill, v).astype(kind)
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "data": [tiff.encoded(out)]})

    filled = inside.select("file", block, "row", "col", *bands).groupBy("file", "block").applyInPandas(one, "file string, block long, data binary")
    empty = tiff.encoded(np.full((TILE, TILE, len(bands)), fill, kind))
    blocks = every.join(filled, ["file", "block"], "left").withColumn("data", F.coalesce("data", F.lit(bytearray(empty))))
    from ..operators.tables import materialised

    blocks = materialised(blocks)
    total = blocks.groupBy("file").agg(F.sum(F.octet_length("data")).cast("long").alias("total"))
    rows = blocks.join(places, "file").join(total, "file").withColumns({"bands": F.lit(len(bands)), "dtype": F.lit(dtype), "nodata": F.lit(nodata).cast("double")})
    rows = rows.withColumns({c: F.col(c).cast("double") for c in geo[1:]}).withColumn("epsg", F.col("epsg").cast("int"))
    rows.repartition("file").sortWithinPartitions("file", "block").write.format("geotiff").mode("append").save(path)


def write_png(pixels: DataFrame, path: str, bands: list[str]) -> None:
    """Writes pixels (file, row, col, bands of 0 to 255) under path as PNG images named as in file: grey, grey and alpha, RGB or RGBA.

    An image's size is that of its last row and column; absent and null pixels are 0. A row of an image is one
    row of the table that is sorted; a file is put together in one task, a row at a time.
    """
    register(pixels.sparkSession)
    sizes = pixels.groupBy("file").agg((F.max("col") + 1).cast("int").alias("width"), (F.max("row") + 1).cast("int").alias("height"))
    values = F.struct("col", *[F.coalesce(F.col(b), F.lit(0)).cast("int").alias(f"v{k}") for k, b in enumerate(bands)])
    lines = pixels.groupBy("file", "row").agg(F.sort_array(F.collect_list(values)).alias("line"))
    every = sizes.select("file", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for width, line in zip(batch.column(3).to_pylist(), batch.column(2)):
                out = np.zeros((width, len(bands)), np.uint8)
                if line.is_valid and len(line):
                    at = line.values.flatten()
                    cols = at[0].to_numpy(zero_copy_only=False)
                    for k in range(len(bands)):
                        out[cols, k] = at[k + 1].to_numpy(zero_copy_only=False).astype(np.uint8)
                data.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), batch.column(4), batch.column(5), pa.array(data, pa.binary())], ["file", "row", "width", "height", "samples", "data"])

    joined = every.join(lines, ["file", "row"], "left").select("file", "row", "line", "width", "height", F.lit(len(bands)).alias("samples"))
    rows = joined.mapInArrow(packed, "file string, row int, width int, height int, samples int, data binary")
    rows.repartition("file").sortWithinPartitions("file", "row").write.format("png").mode("append").save(path)
