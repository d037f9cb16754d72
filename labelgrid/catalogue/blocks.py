"""Images read between their pixels, split to connected parts and refined on a lattice; orders stand in for pixels."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import palettes, taxonomy
from ..operators import components, equalise, polygons, raster, relational, superpixels, warp
from ..plans import experiments, inference, lattice_crf
from ..registry import query, r6, table
from .places import _utm_sql
from .rasters import _IMAGES, _crf_input, image, images

# A source of 40 by 40 pixels of 10 m, and the grid in degrees that it is read at.
_X0, _Y0, _STEP = 500000.0, 4200000.0, 10.0
_LON, _LAT, _DEG, _ROWS, _COLS = -87.0003, 37.9487, 1.3e-4, 36, 41

_CUBIC = "CASE WHEN abs({t}) <= 1 THEN 1.5 * pow(abs({t}), 3) - 2.5 * pow(abs({t}), 2) + 1 WHEN abs({t}) < 2 THEN -0.5 * pow(abs({t}), 3) + 2.5 * pow(abs({t}), 2) - 4 * abs({t}) + 2 ELSE 0 END"
_WEIGHTS = {"nearest": (0, 0, "1"), "bilinear": (0, 1, "1 - abs({t})"), "cubic": (-1, 2, _CUBIC)}


def _reprojected_sql(kernel):
    low, high, weight = _WEIGHTS[kernel]
    base = "floor(s{c} + 0.5)" if kernel == "nearest" else "floor(s{c})"
    at = lambda c: base.format(c=c)
    w = lambda c: weight.format(t=f"(s{c} - {at(c)} - {'i' if c == 'y' else 'j'})")
    grid = f"p AS (SELECT row, col, {_LAT} - (row + 0.5) * {_DEG} AS lat, {_LON} + (col + 0.5) * {_DEG} AS lon FROM range({_ROWS}) a(row), range({_COLS}) b(col))"
    return f"""WITH {_IMAGES}, {grid}, {_utm_sql('lat', 'lon', 16)},
s AS (SELECT row, col, ({_Y0} - y) / {_STEP} - 0.5 AS sy, (x - {_X0}) / {_STEP} - 0.5 AS sx FROM u),
k AS (SELECT *, CAST(greatest(0, least(39, {at('y')} + i)) AS INT) AS r, CAST(greatest(0, least(39, {at('x')} + j)) AS INT) AS c, ({w('y')}) * ({w('x')}) AS w
  FROM s, range({low}, {high + 1}) a(i), range({low}, {high + 1}) b(j) WHERE sy BETWEEN -0.5 AND 39.5 AND sx BETWEEN -0.5 AND 39.5)
SELECT px.image, CAST(k.row AS INT) AS row, CAST(k.col AS INT) AS col, round(sum(w * px.label) / sum(w), 4) AS v FROM k JOIN px ON px.row = k.r AND px.col = k.c GROUP BY 1, 2, 3 HAVING sum(w) > 0.5"""


def _reprojected(spark, d, kernel):
    px = images(spark, d)
    at = px.select("image").distinct()
    layout = lambda h, w, x0, y0, step: at.withColumns({"height": F.lit(h), "width": F.lit(w), "x0": F.lit(x0), "y0": F.lit(y0), "dx": F.lit(step), "dy": F.lit(step)})
    source, target = layout(40, 40, _X0, _Y0, _STEP), layout(_ROWS, _COLS, _LON, _LAT, _DEG)
    out = warp.to_degrees(px.select("image", "row", "col", F.col("label").cast("double").alias("v")), ["image"], "v", source, target, 32616, kernel, block=16)
    return out.where("v IS NOT NULL").withColumn("v", F.round("v", 4))


@query(_reprojected_sql("nearest"))
def r07_r09_reprojected_nearest(spark, d):
    return _reprojected(spark, d, "nearest")


@query(_reprojected_sql("bilinear"))
def r10_reprojected_bilinear(spark, d):
    return _reprojected(spark, d, "bilinear")


@query(_reprojected_sql("cubic"))
def r10_reprojected_cubic(spark, d):
    return _reprojected(spark, d, "cubic")


# Images of 10 by 10 pixels, so that SQL's flood fill ends soon.
_SMALL = """px AS (SELECT CAST(o_orderkey // 100 AS INT) AS image, CAST(o_orderkey // 10 % 10 AS INT) AS row, CAST(o_orderkey % 10 AS INT) AS col,
CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label FROM orders)"""


@query(f"""WITH RECURSIVE {_SMALL},
b AS (SELECT image, label AS s, greatest(min(row) - 1, 0) AS r0, least(max(row) + 1, 9) AS r1, greatest(min(col) - 1, 0) AS c0, least(max(col) + 1, 9) AS c1 FROM px GROUP BY ALL),
c AS (SELECT b.image, b.s, r.r AS row, c.c AS col, r.r * 10 + c.c AS k, coalesce(px.label = b.s, false) AS fg, r.r IN (r0, r1) OR c.c IN (c0, c1) AS rim
  FROM b JOIN range(10) r(r) ON r.r BETWEEN r0 AND r1 JOIN range(10) c(c) ON c.c BETWEEN c0 AND c1 LEFT JOIN px ON px.image = b.image AND px.row = r.r AND px.col = c.c),
e AS (SELECT a.image, a.s, a.k, b.k AS next FROM c a JOIN c b ON b.image = a.image AND b.s = a.s AND b.fg = a.fg AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 AND (a.fg OR abs(b.row - a.row) + abs(b.col - a.col) = 1)),
reach AS (SELECT image, s, k, k AS seen FROM c UNION SELECT r.image, r.s, r.k, e.next FROM reach r JOIN e ON e.image = r.image AND e.s = r.s AND e.k = r.seen),
p AS (SELECT c.image, c.s, c.fg, c.k, min(seen) AS region, bool_or(o.rim) AS rim FROM c JOIN reach r ON r.image = c.image AND r.s = c.s AND r.k = c.k JOIN c o ON o.image = c.image AND o.s = c.s AND o.k = r.seen GROUP BY ALL),
i AS (SELECT image, s, fg, region, row_number() OVER (PARTITION BY image ORDER BY s, NOT fg, region) - 1 AS id FROM (SELECT DISTINCT image, s, fg, region FROM p WHERE fg OR NOT rim)),
d AS (SELECT p.image, p.k, arg_max(i.id, p.s) AS segment FROM p JOIN i ON i.image = p.image AND i.s = p.s AND i.fg = p.fg AND i.region = p.region GROUP BY ALL)
SELECT px.image, px.row, px.col, CAST(coalesce(d.segment, -1) AS BIGINT) AS segment FROM px LEFT JOIN d ON d.image = px.image AND d.k = px.row * 10 + px.col""")
def w11_contour_split(spark, d):
    k = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("label")
    px = table(spark, d, "orders").select(
        F.floor(k / 100).cast("int").alias("image"), F.floor(k / 10 % 10).cast("int").alias("row"), (k % 10).cast("int").alias("col"), label
    )
    return components.split_segments(px, ["image"], "label", 10, 10)


@query()
def m01_lattice_crf(spark, d):
    """One image of all orders, five steps of mean field; held to all pairs of a tile in the tests."""
    out = lattice_crf.refined_on_lattice(_crf_input(image(spark, d)), ["image"], 3, 5.0, 20.0, 2.0, (3.0, 5.0), 5)
    return out.select("row", "col", "label", F.round("prob", 4).alias("prob"))


@query("""WITH e AS (SELECT event_id, 1000.0 * user_id AS east, 10.0 * event_id AS north, radians(value) AS yaw FROM events), g AS (SELECT i, j, 10000 * pow(i / 4.0::DOUBLE, 3) AS x,
(-50 + 100 * j / 3.0::DOUBLE) * pow(1 + 4 * i / 4.0::DOUBLE, 3) AS y FROM range(5) a(i), range(4) b(j))
SELECT event_id, round(avg(east + cos(yaw) * x - sin(yaw) * y), 3) AS x, round(avg(north + sin(yaw) * x + cos(yaw) * y), 3) AS y FROM e, g GROUP BY event_id""")
def g04_g05_g07_j09_placed_grid(spark, d):
    """The ground ahead of each frame: a grid that widens, placed where the frame is and looks."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") * 1000.0).alias("east"), (F.col("event_id") * 10.0).alias("north"), F.radians("value").alias("yaw"))
    seen = e.join(F.broadcast(geo.world_grid(spark, 5, 4)))
    at = geo.placed(F.col("x"), F.col("y"), F.col("yaw"), F.col("east"), F.col("north"))
    return seen.select("event_id", at.alias("p")).groupBy("event_id").agg(F.round(F.avg("p.x"), 3).alias("x"), F.round(F.avg("p.y"), 3).alias("y"))


@query("""WITH n AS (SELECT * FROM (VALUES (0, 'water'), (1, 'low_vegetation, trees'), (2, 'built'), (3, 'ground'), (4, 'sky')) t(idx, names))
SELECT coalesce(names, 'none') AS names, count(*) AS n FROM embeddings LEFT JOIN n ON n.idx = embeddings.label GROUP BY 1""")
def a28_names_of_labels(spark, d):
    names = taxonomy.names_by_index(taxonomy.MORE_COMMON, spark)
    met = table(spark, d, "embeddings").join(names, F.col("label") == F.col("idx"), "left")
    return met.groupBy(F.coalesce("names", F.lit("none")).alias("names")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT label_set, res, printf('%dm', CAST(res AS INT)) AS res_label FROM (SELECT unnest(['A', 'N', 'R']) AS label_set), (SELECT unnest([1.0, 5.0, 10.0])::DOUBLE AS res))
SELECT label_set, res_label, count(l_orderkey) AS runs, round(avg(l_quantity * res), 6) AS score FROM p LEFT JOIN lineitem ON l_returnflag = label_set AND l_linenumber % 3 = CAST(res AS INT) % 3 GROUP BY 1, 2""")
def j10_x08_runs_of_a_plan(spark, d):
    """The runs there are for each setting of a plan, also of those that have none."""
    plan = experiments.grid(spark, {"label_set": ["A", "N", "R"], "res": [1.0, 5.0, 10.0]})
    from ..functions import text

    runs = table(spark, d, "lineitem")
    # Runs go to the few settings, and are counted where they are; settings without runs come in at the end.
    met = runs.join(F.broadcast(plan), (F.col("l_returnflag") == F.col("label_set")) & (F.col("l_linenumber") % 3 == F.col("res").cast("int") % 3))
    found = met.groupBy("label_set", "res").agg(F.count("l_orderkey").alias("runs"), r6(F.avg(F.col("l_quantity") * F.col("res"))).alias("score"))
    every = plan.join(found, ["label_set", "res"], "left")
    return every.select("label_set", text.resolution_label(F.col("res")).alias("res_label"), F.coalesce("runs", F.lit(0)).cast("long").alias("runs"), "score")


@query("""SELECT o_orderkey, o_totalprice AS value, l.n AS lines, NULL::DOUBLE AS depth FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def j06_optional_layers(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("value"))
    base = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return relational.aligned_layers(base, {"lines": lines, "depth": None}, ["o_orderkey"])


# An outer ring with a bay and a hole for each nation.
_OUTER = [(0, 0), (4, 0), (4, 1.5), (1.5, 1.5), (1.5, 4), (0, 3)]
_HOLE = [(0.3, 0.3), (0.9, 0.35), (0.6, 1.1)]
_RINGS = ", ".join(f"({r}, {k}, {x}, {y}, {ring[(k + 1) % len(ring)][0]}, {ring[(k + 1) % len(ring)][1]})" for r, ring in enumerate((_OUTER, _HOLE)) for k, (x, y) in enumerate(ring))


@query(f"""WITH p AS (SELECT c_custkey, c_acctbal / 1000.0::DOUBLE AS x, c_custkey % 97 / 10.0::DOUBLE AS y FROM customer),
e AS (SELECT n_nationkey, n_nationkey % 6 + x0 AS x0, n_nationkey % 7 * 0.8::DOUBLE + y0 AS y0, n_nationkey % 6 + x1 AS x1, n_nationkey % 7 * 0.8::DOUBLE + y1 AS y1
  FROM nation, (VALUES {_RINGS}) t(ring, k, x0, y0, x1, y1)),
c AS (SELECT c_custkey, n_nationkey, count(*) AS n FROM p, e WHERE (y0 <= y) <> (y1 <= y) AND x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x GROUP BY ALL)
SELECT c_custkey, n_nationkey FROM c WHERE n % 2 = 1""")
def j08_points_in_polygons(spark, d):
    tenth = lambda v: F.lit(str(v)).cast("decimal(3,1)")  # noqa: E731  x in decimals, as SQL has it: a side's width is exact
    ring = lambda points: F.array(*[F.struct((F.col("n_nationkey") % 6 + tenth(x)).alias("x"), (F.col("n_nationkey") % 7 * F.lit(0.8) + F.lit(float(y))).alias("y")) for x, y in points])
    rings = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(ring(_OUTER), ring(_HOLE))).alias("ring"))
    points = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") % 97 / 10.0).alias("y"))
    return polygons.points_in_polygons(points, polygons.edges_of(rings, "n_nationkey", "ring"), "n_nationkey", 0.7).select("c_custkey", "n_nationkey")


@query()
def m05_superpixels(spark, d):
    """Superpixels of all images, small pieces joined to their neighbours; held to plain loops in the tests."""
    px = images(spark, d).select("image", "row", "col", F.array(F.col("v") / 5000, F.col("label") * 20.0).alias("features"))
    found = superpixels.slic(px, ["image"], "features", 40, 40, 16, rounds=2)
    return superpixels.connected(found, ["image"], "segment", 40, 40, 12)


@query(f"""WITH {_IMAGES}, g AS (SELECT image, row, col, CAST(floor(v) AS BIGINT) % 64 AS g FROM px),
t AS (SELECT image, row // 10 AS ti, col // 10 AS tj, g, count(*) AS n FROM g GROUP BY ALL),
a AS (SELECT image, ti, tj, sum(n) AS all_n FROM t GROUP BY ALL),
h AS (SELECT a.image, a.ti, a.tj, l.l AS g, coalesce(t.n, 0) AS n, all_n, greatest(1, CAST(floor(2.0 * all_n / 64) AS BIGINT)) AS lim FROM a CROSS JOIN range(64) l(l) LEFT JOIN t ON t.image = a.image AND t.ti = a.ti AND t.tj = a.tj AND t.g = l.l),
o AS (SELECT *, sum(greatest(0, n - lim)) OVER (PARTITION BY image, ti, tj) AS over_n FROM h),
m AS (SELECT image, ti, tj, g, sum(least(n, lim) + CAST(over_n AS BIGINT) // 64 + CASE WHEN g < over_n % 64 THEN 1 ELSE 0 END) OVER (PARTITION BY image, ti, tj ORDER BY g) * 63.0::DOUBLE / all_n AS mapped FROM o),
w AS (SELECT image, row, col, g, least(3, greatest(0, CAST(floor((row + 0.5) / 10 - 0.5) AS INT) + i.i)) AS ti, least(3, greatest(0, CAST(floor((col + 0.5) / 10 - 0.5) AS INT) + j.j)) AS tj,
  abs(1 - i.i - ((row + 0.5) / 10 - 0.5 - floor((row + 0.5) / 10 - 0.5))) * abs(1 - j.j - ((col + 0.5) / 10 - 0.5 - floor((col + 0.5) / 10 - 0.5))) AS w FROM g, range(2) i(i), range(2) j(j))
SELECT w.image, w.row, w.col, round(sum(w.w * m.mapped) / sum(w.w), 6) AS v FROM w JOIN m ON m.image = w.image AND m.ti = w.ti AND m.tj = w.tj AND m.g = w.g GROUP BY ALL""")
def w12_r25_equalised(spark, d):
    px = images(spark, d).select("image", "row", "col", (F.floor("v") % 64).cast("int").alias("v"))
    return equalise.equalised(px, ["image"], "v", 40, 40, tile=10, clip=2.0, levels=64).withColumn("v", r6("v"))


_LENS, _SIDE = (-0.3, 0.12, -0.02), (0.001, -0.0007)


@query("""SELECT event_id, round((event_id % 640 - 320) / 400.0::DOUBLE, 6) AS x, round((user_id % 512 - 256) / 400.0::DOUBLE, 6) AS y FROM events""")
def g17_lens_there_and_back(spark, d):
    """Points bent by a lens and taken back are where they were."""
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 640 - 320) / 400.0).alias("x"), ((F.col("user_id") % 512 - 256) / 400.0).alias("y"))
    bent = e.select("event_id", F.inline(F.array(geo.distorted(F.col("x"), F.col("y"), _LENS, _SIDE))))
    back = bent.select("event_id", F.inline(F.array(geo.undistorted(F.col("x"), F.col("y"), _LENS, _SIDE, 60))))
    zero = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return back.select("event_id", zero("x"), zero("y"))


@query(f"""WITH {_IMAGES}, g AS (SELECT i.image, r.r AS row, c.c AS col, coalesce(px.v, 0) AS v FROM (SELECT DISTINCT image FROM px) i CROSS JOIN range(40) r(r) CROSS JOIN range(40) c(c)
  LEFT JOIN px ON px.image = i.image AND px.row = r.r AND px.col = c.c)
SELECT image, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(v + coalesce(lag(v) OVER l, 0) + coalesce(lead(v) OVER l, 0) + 1.5 * (coalesce(lag(v) OVER k, 0) + coalesce(lead(v) OVER k, 0)), 3) AS score FROM g
WINDOW l AS (PARTITION BY image, row ORDER BY col), k AS (PARTITION BY image, col ORDER BY row)""")
def m04_four_flips(spark, d):
    """A model that looks to the right and down, over tiles turned four ways."""
    px = images(spark, d)
    tiles = raster.dense_tiles(px, ["image"], "v", 40, 40)

    def model():
        import numpy as np

        def score(x):
            wide = np.pad(x, ((0, 0), (0, 1), (0, 1), (0, 0)))
            return wide[:, :-1, :-1] + 2 * wide[:, :-1, 1:] + 3 * wide[:, 1:, :-1]

        return score

    said = inference.predicted(tiles, "data", (40, 40, 1), model, 1).select("image", F.posexplode("data").alias("k", "score"))
    return said.select("image", F.floor(F.col("k") / 40).cast("int").alias("row"), (F.col("k") % 40).alias("col"), F.round("score", 3).alias("score"))


_COLOURS = ", ".join(f"('{name}', {k}, {r}, {g}, {b})" for name, p in palettes.PALETTES.items() for k, (r, g, b) in p.items())


@query(f"""WITH c AS (SELECT * FROM (VALUES {_COLOURS}) t(palette, label, r, g, b)), l AS (SELECT l_orderkey % 15 AS label FROM lineitem)
SELECT p.palette, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b, count(*) AS n FROM l CROSS JOIN (SELECT DISTINCT palette FROM c) p
LEFT JOIN c ON c.palette = p.palette AND c.label = l.label GROUP BY ALL""")
def r22_palettes(spark, d):
    """Labels as colours of each of the palettes."""
    labels = table(spark, d, "lineitem").select((F.col("l_orderkey") % 15).alias("label"))
    shown = F.array(*[F.struct(F.lit(name).alias("palette"), palettes.colour(F.col("label"), p).alias("c")) for name, p in palettes.PALETTES.items()])
    return labels.select(F.inline(shown)).select("palette", "c.*").groupBy("palette", "r", "g", "b").agg(F.count("*").alias("n"))
