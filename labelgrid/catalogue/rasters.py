"""Raster operators; orders, forty to a row, stand in for a dense image."""

from pyspark.sql import functions as F

from ..operators import components, metrics, raster
from ..plans import small_crf
from ..registry import query, r6, table

_PX = """px AS (SELECT CAST(o_orderkey // 40 AS INT) AS row, CAST(o_orderkey % 40 AS INT) AS col, o_totalprice AS v,
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, CAST((o_orderkey * 7 + o_custkey) % 3 AS INT) AS pred FROM orders)"""
_NEAR = "JOIN px b ON abs(a.row - b.row) <= {r} AND abs(a.col - b.col) <= {r}"


def image(spark, d):
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, d, "orders").select(
        F.lit(0).alias("image"), F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.col("o_totalprice").alias("v"),
        label.alias("label"), ((k * 7 + F.col("o_custkey")) % 3).cast("int").alias("pred"),
    )


# Many images of 40 by 40 pixels, as many as the table has room for.
_IMAGES = """px AS (SELECT CAST(o_orderkey // 1600 AS INT) AS image, CAST(o_orderkey // 40 % 40 AS INT) AS row, CAST(o_orderkey % 40 AS INT) AS col, o_totalprice AS v,
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label, CAST((o_orderkey * 7 + o_custkey) % 3 AS INT) AS pred FROM orders)"""


def images(spark, d):
    px = image(spark, d)
    return px.withColumn("image", F.floor(F.col("row") / 40).cast("int")).withColumn("row", F.col("row") % 40)


_OFF = lambda r: f"(SELECT i.i, j.j FROM range(-{r}, {r} + 1) i(i), range(-{r}, {r} + 1) j(j))"


def _focal(r, agg, extra=""):
    return f"WITH {_PX} SELECT a.row, a.col, {agg} FROM px a, {_OFF(r)} o JOIN px b ON b.row = a.row + o.i AND b.col = a.col + o.j {extra} GROUP BY a.row, a.col"


@query(_focal(1, "round(max(b.v), 4) AS top, round(min(b.v), 4) AS low"))
def w03_w04_focal_max_min(spark, d):
    px = image(spark, d).select("image", "row", "col", F.col("v").alias("top"), F.col("v").alias("low"))
    out = raster.focal_dense(raster.focal_dense(px, ["image"], "top", 1, "max"), ["image"], "low", 1, "min")
    return out.select("row", "col", F.round("top", 4).alias("top"), F.round("low", 4).alias("low"))


@query(_focal(2, "min(b.label) AS eroded", "WHERE o.i * o.i + o.j * o.j <= 4"))
def w06_disk_erosion(spark, d):
    px = image(spark, d).select("row", "col", "label")
    return raster.focal(px, [], "label", raster.disk(2), F.array_min).select("row", "col", F.col("label").alias("eroded"))


@query(f"""WITH {_PX}, m AS (SELECT a.row, a.col, b.v FROM px a, {_OFF(2)} o LEFT JOIN px b ON b.row = a.row + o.i AND b.col = a.col + o.j)
SELECT row, col, round(list_sort(list(coalesce(v, 0)))[13], 4) AS median FROM m GROUP BY row, col""")
def w08_median(spark, d):
    px = image(spark, d).select("row", "col", "v")
    return raster.median(px, [], "v", 2).select("row", "col", F.round("v", 4).alias("median"))


@query(f"""WITH {_PX}, e AS (SELECT a.row, a.col, min(b.v) AS v FROM px a, {_OFF(1)} o JOIN px b ON b.row = a.row + o.i AND b.col = a.col + o.j GROUP BY 1, 2)
SELECT a.row, a.col, round(max(b.v), 4) AS opened FROM e a, {_OFF(1)} o JOIN e b ON b.row = a.row + o.i AND b.col = a.col + o.j GROUP BY 1, 2""")
def w05_opening(spark, d):
    return raster.opened(image(spark, d).select("image", "row", "col", "v"), ["image"], "v", 1).select("row", "col", F.round("v", 4).alias("opened"))


@query(f"""WITH {_PX}, h AS (SELECT row, col, CASE WHEN label = 2 THEN 255 ELSE label END AS label FROM px),
n AS (SELECT a.row, a.col, a.label, max(CASE WHEN b.label = 255 THEN 1 ELSE 0 END) AS near FROM h a, {_OFF(2)} o JOIN h b ON b.row = a.row + o.i AND b.col = a.col + o.j GROUP BY 1, 2, 3),
m AS (SELECT label FROM n WHERE near = 1 AND label <> 255 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT row, col, CASE WHEN h.label = 255 THEN (SELECT label FROM m) ELSE h.label END AS label FROM h""")
def a11_border_mode_fill(spark, d):
    px = image(spark, d).select("image", "row", "col", F.when(F.col("label") == 2, 255).otherwise(F.col("label")).alias("label"))
    return raster.border_mode_fill(px, ["image"], "label").select("row", "col", "label")


def _pool(src, name, r, expr):
    return f"SELECT a.class, a.row, a.col, {expr} AS {name} FROM {src} a, {_OFF(r)} o JOIN {src} b ON b.class = a.class AND b.row = a.row + o.i AND b.col = a.col + o.j GROUP BY a.class, a.row, a.col"


@query(f"""WITH {_PX}, k AS (SELECT c.c AS class, row, col, label, CASE WHEN label = c.c THEN 1 ELSE 0 END AS g, CASE WHEN pred = c.c THEN 1 ELSE 0 END AS p FROM px, range(3) c(c)),
b1 AS ({_pool('k', 'gm', 1, 'max(1 - b.g)')}), b2 AS ({_pool('k', 'pm', 1, 'max(1 - b.p)')}),
e AS (SELECT k.class, k.row, k.col, b1.gm - (1 - k.g) AS gb, b2.pm - (1 - k.p) AS pb FROM k JOIN b1 USING (class, row, col) JOIN b2 USING (class, row, col)),
x AS (SELECT a.class, a.row, a.col, max(b.gb) AS ge, max(b.pb) AS pe FROM e a, {_OFF(2)} o JOIN e b ON b.class = a.class AND b.row = a.row + o.i AND b.col = a.col + o.j GROUP BY 1, 2, 3),
s AS (SELECT class, sum(pb * ge) / (sum(pb) + 1e-7) AS p, sum(pe * gb) / (sum(gb) + 1e-7) AS r FROM e JOIN x USING (class, row, col) GROUP BY class)
SELECT round(avg(1 - 2 * p * r / (p + r + 1e-7)), 6) AS boundary_metric FROM s""")
def a16_a17_boundary_metric(spark, d):
    sums = raster.boundary_sums(image(spark, d), ["image"], "label", "pred", [0, 1, 2])
    return metrics.boundary_f1(sums, ["image"]).select(r6("boundary_metric").alias("boundary_metric"))


_TILES = "t AS (SELECT l_partkey AS cell, CAST(round(l_discount * 100) AS INT) AS v, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_extendedprice, e := l_quantity, f := l_shipdate) AS o FROM lineitem)"


def tiles(spark, d):
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("cell"), F.round(F.col("l_discount") * 100).cast("int").alias("v"), order.alias("o"))


@query(f"WITH {_TILES} SELECT cell, coalesce(arg_min(v, o) FILTER (WHERE v <> 0), 0) AS v FROM t GROUP BY cell")
def r06_mosaic_first(spark, d):
    return raster.mosaic_first(tiles(spark, d), ["cell"], "v", F.col("o"))


@query(f"WITH {_TILES} SELECT cell, arg_max(v, o) FILTER (WHERE v > 2) AS v FROM t GROUP BY cell")
def r06b_mosaic_last(spark, d):
    masked = tiles(spark, d).withColumn("v", F.when(F.col("v") > 2, F.col("v")))
    return raster.mosaic_last(masked, ["cell"], "v", F.col("o"))


@query("""WITH e AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE o_totalprice END AS v FROM orders),
q AS (SELECT o_orderstatus, quantile_cont(v, 0.999) AS top FROM e GROUP BY 1)
SELECT o_orderkey, round(least(greatest(v, 0), top), 4) AS v FROM e JOIN q USING (o_orderstatus)""")
def r02_clean_elevation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, -9999.0).otherwise(F.col("o_totalprice")).alias("v"))
    return raster.clean_elevation(o, ["o_orderstatus"], "v").select("o_orderkey", F.round("v", 4).alias("v"))


@query("""WITH e AS (SELECT o_orderkey, o_totalprice - o_custkey * 1000.0 AS v FROM orders), q AS (SELECT quantile_cont(v, 0.999) AS top FROM e)
SELECT o_orderkey, round(least(greatest(v, 0), top), 4) AS height FROM e, q""")
def r03_surface_height(spark, d):
    o = table(spark, d, "orders").select(F.lit(0).alias("image"), "o_orderkey", F.col("o_totalprice").alias("dsm"), (F.col("o_custkey") * 1000.0).alias("dem"))
    return raster.surface_height(o, ["image"], "dsm", "dem").select("o_orderkey", F.round("height", 4).alias("height"))


@query("""SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER w) * 255 / (max(o_totalprice) OVER w - min(o_totalprice) OVER w), 4) AS v FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""")
def a24_r24_min_max_8bit(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("v"))
    return raster.min_max_8bit(o, ["o_orderpriority"], "v").select("o_orderkey", F.round("v", 4).alias("v"))


@query(f"""WITH {_PX}, c AS (SELECT row - 3 AS row, col - 5 AS col, v FROM px WHERE row >= 3 AND row < 20 AND col >= 5 AND col < 30)
SELECT 16 - row AS row, 24 - col AS col, CAST(least(floor(row * 17 / 8.0::DOUBLE), 16) AS INT) AS source_row, round(v, 4) AS v FROM c""")
def r11_r19_r23_x19_crop_and_turn(spark, d):
    c = raster.cropped(image(spark, d).select("row", "col", "v"), (3, 20), (5, 30))
    row, col = raster.rotated_half_turn(F.col("row"), F.col("col"), 17, 25)
    return c.select(row.alias("row"), col.alias("col"), raster.nearest_index(F.col("row"), 17, 8).alias("source_row"), F.round("v", 4).alias("v"))


def _starts(size, tile):
    return ", ".join(map(str, raster.tile_starts(size, tile)))


@query(f"""WITH {_IMAGES}, r AS (SELECT s, row_number() OVER () - 1 AS k FROM (SELECT unnest([{_starts(40, 16)}]) AS s)), c AS (SELECT s, row_number() OVER () - 1 AS k FROM (SELECT unnest([{_starts(40, 16)}]) AS s))
SELECT image, CAST(r.k * {len(raster.tile_starts(40, 16))} + c.k AS INT) AS tile_no, count(*) AS pixels, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::BIGINT AS ones, round(avg(v), 4) AS mean
FROM px, r, c WHERE row >= r.s AND row < r.s + 16 AND col >= c.s AND col < c.s + 16 GROUP BY 1, 2 HAVING sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) <> 0""")
def w09_f13_training_tiles(spark, d):
    t = raster.tiled(images(spark, d), 40, 40, 16).groupBy("image", "tile_no").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum((F.col("label") == 1).cast("int")).alias("ones"), F.round(F.avg("v"), 4).alias("mean")
    )
    return t.where("ones <> 0").select("image", F.col("tile_no").cast("int").alias("tile_no"), "pixels", "ones", "mean")


@query(f"""WITH {_IMAGES}, s AS (SELECT image, row, col, v, pr.pr AS pr, pc.pc AS pc, row - pr.pr * 12 AS i, col - pc.pc * 12 AS j FROM px, range(3) pr(pr), range(3) pc(pc)
WHERE row >= pr.pr * 12 AND row < pr.pr * 12 + 16 AND col >= pc.pc * 12 AND col < pc.pc * 12 + 16),
w AS (SELECT *, CASE WHEN i >= 12 THEN 1 - (i - 11) * 0.2 ELSE 1 END * CASE WHEN i <= 3 THEN 1 - (4 - i) * 0.2 ELSE 1 END *
CASE WHEN j >= 12 THEN 1 - (j - 11) * 0.2 ELSE 1 END * CASE WHEN j <= 3 THEN 1 - (4 - j) * 0.2 ELSE 1 END AS w FROM s)
SELECT image, row, col, round(sum(w * (v + 100 * pr + 10 * pc)) / sum(w), 4) AS v FROM w GROUP BY image, row, col""")
def w10_tapered_blend(spark, d):
    p = raster.in_patches(images(spark, d), 40, 40, 16, 12).withColumn("v", F.col("v") + 100 * F.col("pr") + 10 * F.col("pc"))
    return raster.blended(p, ["image"], "v", 16, 12).select("image", "row", "col", F.round("v", 4).alias("v"))


@query(f"""WITH RECURSIVE {_IMAGES}, p AS (SELECT image, row, col, label, row * 40 + col AS k FROM px),
e AS (SELECT a.image, a.k, b.k AS next FROM p a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(i, j) JOIN p b ON b.image = a.image AND b.row = a.row + o.i AND b.col = a.col + o.j AND b.label = a.label),
reach AS (SELECT image, k, k AS seen FROM p UNION SELECT r.image, r.k, e.next FROM reach r JOIN e ON e.image = r.image AND e.k = r.seen)
SELECT p.image, p.row, p.col, p.label, CAST(min(seen) AS BIGINT) AS region FROM p JOIN reach ON reach.image = p.image AND reach.k = p.k GROUP BY 1, 2, 3, 4""")
def w11_regions(spark, d):
    """Connected regions of equal label; held to a flood fill in the tests too."""
    px = images(spark, d).select("image", "row", "col", "label")
    return components.regions(px, ["image"], "label", 40, 40)


def _crf_input(px):
    probs = F.array(*[F.when(F.col("label") == k, 0.8).otherwise(0.1) for k in range(3)])
    return px.select("image", "row", "col", probs.alias("probs"), F.array(F.col("v") / 10000).alias("features"))


@query()
def m01_small_crf(spark, d):
    """Exact mean-field on tiles of 10 by 10 pixels; held to a direct computation in the tests."""
    tile = F.floor(F.col("row") / 10) * 4 + F.floor(F.col("col") / 10)
    tiles = _crf_input(image(spark, d)).withColumn("tile", tile)
    return small_crf.refined(tiles, "tile", 3).select("tile", "row", "col", "label", r6("prob").alias("prob"))


@query()
def m02_crf_in_patches(spark, d):
    """Mean-field on overlapping patches of images, blended; held to a direct computation in the tests."""
    out = small_crf.refined_in_patches(_crf_input(images(spark, d)), ["image"], 40, 40, 3, 16, 12)
    return out.select("image", "row", "col", "label", r6("prob").alias("prob"))


@query("""WITH t AS (SELECT CAST(l_quantity AS INT) AS px, l_linestatus AS img, arg_min(CAST(l_suppkey % 9 AS INT), struct_pack(a := l_extendedprice, b := l_orderkey, c := l_linenumber, d := l_suppkey)) + 1 AS label FROM lineitem GROUP BY 1, 2),
g AS (SELECT img, CAST(p AS INT) AS px FROM (SELECT DISTINCT l_linestatus AS img FROM lineitem), range(0, 60) r(p))
SELECT g.img, g.px, coalesce(t.label, 0) AS label, CASE WHEN t.label IS NULL THEN 255 ELSE t.label - 1 END AS mask FROM g LEFT JOIN t ON t.img = g.img AND t.px = g.px""")
def g16_nearest_splat(spark, d):
    """The label of the nearest point in each pixel, of a wider row of pixels."""
    depth = F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey")
    points = table(spark, d, "lineitem").select(
        F.col("l_quantity").cast("int").alias("px"), F.col("l_linestatus").alias("img"), (F.col("l_suppkey") % 9).cast("int").alias("label"), depth.alias("depth")
    )
    grid = points.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("px"))
    splat = raster.nearest_splat(points, ["img", "px"], F.col("depth"), "label")
    return raster.filled_splat(splat, grid, ["img", "px"], "label").withColumn("mask", raster.unrendered_to_sky(F.col("label")))


_SOFTP = "CASE WHEN pred = c.c THEN 0.75 ELSE 0.125 END"


def _pooled(src, names, r):
    """SQL: the largest of each name over the square of radius r, along rows and then along columns."""
    line = lambda a, b: f"OVER (PARTITION BY image, class, {a} ORDER BY {b} RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
    once = ", ".join(f"max({x}) {line('row', 'col')} AS {n}" for n, x in names.items())
    twice = ", ".join(f"max({n}) {line('col', 'row')} AS {n}" for n in names)
    return f"SELECT * EXCLUDE ({', '.join(names)}), {twice} FROM (SELECT *, {once} FROM {src})"


@query(f"""WITH {_IMAGES}, k AS (SELECT image, c.c AS class, row, col, CASE WHEN label = c.c THEN 1.0 ELSE 0.0 END::DOUBLE AS g, {_SOFTP}::DOUBLE AS p FROM px, range(3) c(c)),
n1 AS ({_pooled('k', {'gm': '1 - g', 'pm': '1 - p'}, 1)}), b AS (SELECT *, gm - (1 - g) AS gb, pm - (1 - p) AS pb FROM n1),
x AS ({_pooled('b', {'ge': 'gb', 'pe': 'pb'}, 2)}),
s AS (SELECT image, class, sum(pb * ge) / (sum(pb) + 1e-7) AS p, sum(pe * gb) / (sum(gb) + 1e-7) AS r FROM x GROUP BY 1, 2)
SELECT image, round(avg(1 - 2 * p * r / (p + r + 1e-7)), 6) AS boundary_metric FROM s GROUP BY image""")
def a17_soft_boundary_loss(spark, d):
    probs = F.array(*[F.when(F.col("pred") == k, 0.75).otherwise(0.125) for k in range(3)])
    px = images(spark, d).select("image", "row", "col", "label", probs.alias("probs"))
    return metrics.boundary_f1(raster.soft_boundary_sums(px, ["image"], "label", "probs", [0, 1, 2]), ["image"]).withColumn("boundary_metric", r6("boundary_metric"))
