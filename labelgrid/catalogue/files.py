"""Raster files: written from a table, read again, and held to that table."""

import uuid

from pyspark.sql import functions as F

from ..operators.tables import built, shared_folder
from ..registry import query, r6, table
from ..sources import rasters
from .rasters import _IMAGES, images

# Images 600 pixels wide and 400 high at most, so a file has six tiles.
_WIDE = """px AS (SELECT 'place-' || (o_orderkey // 240000) || '.tif' AS file, CAST(o_orderkey % 240000 // 600 AS INT) AS row, CAST(o_orderkey % 600 AS INT) AS col,
o_totalprice AS price, o_custkey AS cust FROM orders)"""


def _wide(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("place-"), F.floor(k / 240000).cast("string"), F.lit(".tif")).alias("file"), F.floor(k % 240000 / 600).cast("int").alias("row"),
        (k % 600).cast("int").alias("col"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"),
    )


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(spark, d):
    """Where the images of orders are written as GeoTIFFs of two bands."""
    pixels, at = _wide(spark, d), _folder(spark, "geotiff")
    layouts = pixels.select("file").distinct().select(
        "file", F.lit(600).alias("width"), F.lit(400).alias("height"), F.lit(32617).alias("epsg"), F.lit(5e5).alias("x0"), F.lit(4.4e6).alias("y0"), F.lit(3.0).alias("dx"), F.lit(3.0).alias("dy")
    )
    rasters.write_geotiff(pixels, layouts, at, ["price", "cust"], "float64", -9999.0)
    return at


@query(f"""WITH {_WIDE} SELECT file, row, count(*) AS n, round(sum(price), 4) AS price, CAST(sum(cust) AS DOUBLE) AS cust, CAST(sum(col) AS BIGINT) AS cols FROM px GROUP BY file, row""")
def s09_s10_geotiff_pixels(spark, d):
    px = rasters.read_geotiff(spark, _written(spark, d), masked=True, task=1 << 18).where("b1 IS NOT NULL")
    file = F.substring_index("file", "/", -1).alias("file")
    return px.groupBy(file, "row").agg(F.count("*").alias("n"), F.round(F.sum("b1"), 4).alias("price"), F.sum("b2").alias("cust"), F.sum("col").alias("cols"))


@query(f"""WITH {_WIDE} SELECT row, col, cust FROM px WHERE file = 'place-0.tif' AND row BETWEEN 10 AND 59 AND col BETWEEN 200 AND 399""")
def s09_window_of_a_band(spark, d):
    px = rasters.read_geotiff(spark, f"{_written(spark, d)}/place-0.tif", bands=[2], window=(10, 200, 60, 400), masked=True)
    return px.where("b2 IS NOT NULL").select("row", "col", F.col("b2").alias("cust"))


@query(f"""WITH {_WIDE} SELECT DISTINCT file, 600 AS width, 400 AS height, 2 AS bands, 'float64' AS dtype, -9999.0::DOUBLE AS nodata, 32617 AS epsg,
500000.0::DOUBLE AS x0, 4400000.0::DOUBLE AS y0, 3.0::DOUBLE AS dx, 3.0::DOUBLE AS dy FROM px""")
def s10_layouts(spark, d):
    return rasters.read_layouts(spark, _written(spark, d)).withColumn("file", F.substring_index("file", "/", -1))


@query(f"""WITH {_IMAGES} SELECT 'mask-' || image || '.png' AS file, label * 100 + 20 AS red, pred * 100 AS green, count(*) AS n FROM px GROUP BY ALL""")
def s11_s12_png_masks(spark, d):
    px, at = images(spark, d), _folder(spark, "png")
    name = F.concat(F.lit("mask-"), F.col("image").cast("string"), F.lit(".png")).alias("file")
    rasters.write_png(px.select(name, "row", "col", (F.col("label") * 100 + 20).alias("r"), (F.col("pred") * 100).alias("g"), F.lit(255).alias("b")), at, ["r", "g", "b"])
    back = rasters.read_png(spark, at).where("b3 = 255")
    file = F.substring_index("file", "/", -1).alias("file")
    return back.groupBy(file, F.col("b1").alias("red"), F.col("b2").alias("green")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY 1")
def s27_s28_built_once(spark, d):
    def build():
        return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), r6(F.avg("o_totalprice")).alias("price"))

    return built(spark, "orders by priority", [f"{d}/orders.parquet"], build)
