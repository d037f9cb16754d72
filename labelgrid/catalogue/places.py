"""Geometry: poses, projection and grids; events and customers stand in for frames and points."""

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..plans import experiments
from ..registry import query, r6, table

_PTS = "p AS (SELECT c_custkey, 37.5 + c_nationkey / 50.0::DOUBLE AS lat, -84.9 + c_acctbal / 10000.0::DOUBLE AS lon FROM customer)"


def _utm_sql(lat, lon, zone):
    """Spherical-to-plane steps of the series as DuckDB columns."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    r = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    e = 2 * n**0.5 / (1 + n)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    xi = " + ".join(["xi", *[f"{v!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(al, 1)]])
    eta = " + ".join(["eta", *[f"{v!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(al, 1)]])
    return f"""u1 AS (SELECT *, sin(radians({lat})) AS s, radians({lon} - ({zone * 6 - 183})) AS lam FROM p),
u2 AS (SELECT *, sinh(atanh(s) - {e!r} * atanh({e!r} * s)) AS t FROM u1),
u3 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM u2),
u AS (SELECT *, 500000 + {0.9996 * r!r} * ({eta}) AS x, {0.9996 * r!r} * ({xi}) AS y FROM u3)"""


@query(f"WITH {_PTS}, {_utm_sql('lat', 'lon', 16)} SELECT c_custkey, round(x, 3) AS x, round(y, 3) AS y FROM u")
def g01_utm(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (37.5 + F.col("c_nationkey") / 50.0).alias("lat"), (-84.9 + F.col("c_acctbal") / 10000.0).alias("lon"))
    return c.select("c_custkey", geo.utm(F.col("lat"), F.col("lon"), 32616).alias("u")).select("c_custkey", F.round("u.x", 3).alias("x"), F.round("u.y", 3).alias("y"))


@query("""WITH g AS (SELECT r.r AS row, c.c AS col, CAST((r.r * 31 + c.c * 7) % 9 AS INT) AS label FROM range(25) r(r), range(40) c(c)),
p AS (SELECT c_custkey, CAST(greatest(0, least(floor((24.0 - c_nationkey)/1.0), 24)) AS BIGINT) AS row, CAST(greatest(0, least(floor((c_acctbal + 500)/250.0), 39)) AS BIGINT) AS col FROM customer)
SELECT c_custkey, CAST(p.row AS INT) AS row, CAST(p.col AS INT) AS col, label FROM p JOIN g ON p.row = g.row AND p.col = g.col""")
def j07_g02_nearest_cell(spark, d):
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = spark.range(1).select(axis(25).alias("row")).select("row", axis(40).alias("col")).withColumn("label", ((F.col("row") * 31 + F.col("col") * 7) % 9).cast("int"))
    at = geo.cell(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), -500.0, 24.0, 1.0, 25, 40)
    col = geo.cell(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), -500.0, 24.0, 250.0, 25, 40)["col"]
    return table(spark, d, "customer").select("c_custkey", at["row"].alias("row"), col.alias("col")).join(g, ["row", "col"]).select("c_custkey", "row", "col", "label")


@query("""WITH g AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM range(250) a(i), range(200) b(j))
SELECT i, j, round(10000 * pow(i / 249.0::DOUBLE, 3), 4) AS x, round((-50 + 100 * j / 199.0::DOUBLE) * pow(1 + 4 * i / 249.0::DOUBLE, 3), 4) AS y FROM g""")
def g04_g05_j09_world_grid(spark, d):
    return geo.world_grid(spark).select("i", "j", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_Q = """q AS (SELECT event_id, value AS a, sin(event_id) AS b, cos(event_id * 2) AS c, 1.5::DOUBLE AS e FROM events),
n AS (SELECT event_id, sqrt(b*b + c*c + e*e + 0.01) AS m, 0.1::DOUBLE AS x0, b, c, e FROM q),
u AS (SELECT event_id, x0 / m AS x, b / m AS y, c / m AS z, e / m AS w FROM n),
r AS (SELECT event_id, degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))) AS yaw, degrees(asin(greatest(-1, least(1, 2*(w*y - z*x))))) AS pitch,
degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y))) AS roll FROM u)"""


def euler(spark, d):
    i = F.col("event_id").cast("double")
    e = geo.euler_zyx(F.lit(0.1), F.sin(i), F.cos(i * 2), F.lit(1.5))
    return table(spark, d, "events").select("event_id", e.alias("e")).select("event_id", "e.*")


@query(f"WITH {_Q} SELECT event_id, round(yaw, 5) AS yaw, round(pitch, 5) AS pitch, round(roll, 5) AS roll, round(cos(radians(yaw)), 5) AS ahead FROM r")
def g06_g08_euler(spark, d):
    return euler(spark, d).select(
        "event_id", F.round("yaw", 5).alias("yaw"), F.round("pitch", 5).alias("pitch"), F.round("roll", 5).alias("roll"),
        F.round(geo.heading(F.radians("yaw"))["ahead_x"], 5).alias("ahead"),
    )


@query(f"""WITH {_Q}, a AS (SELECT event_id, radians(pitch) AS p, radians(-roll) AS o FROM r),
v AS (SELECT event_id, cos(p)*100 + sin(p)*sin(o)*20 + sin(p)*cos(o)*(-30) AS f, cos(o)*20 - sin(o)*(-30) AS g, -sin(p)*100 + cos(p)*sin(o)*20 + cos(p)*cos(o)*(-30) AS h FROM a),
w AS (SELECT event_id, f, g, h, CASE WHEN f <> 0 THEN CAST(trunc((400*g + 320*f) / f) AS INT) END AS u, CASE WHEN f <> 0 THEN CAST(trunc((400*h + 256*f) / f) AS INT) END AS v FROM v)
SELECT event_id, round(f, 4) AS ahead, round(g, 4) AS side, round(h, 4) AS down, u, v, abs(u) < 640 AND abs(v) < 512 AS seen FROM w""")
def g09_g11_f11_projection(spark, d):
    m = geo.level_rotation(F.col("pitch"), F.col("roll"))
    f, g, h = geo.rotate(m, (F.lit(100.0), F.lit(20.0), F.lit(-30.0)))
    moved = euler(spark, d).select("event_id", f.alias("f"), g.alias("g"), h.alias("h"))
    camera = [[400, 0, 320, 0], [0, 400, 256, 0], [0, 0, 1, 0]]
    shot = moved.select("*", geo.project((F.col("f"), F.col("g"), F.col("h")), camera).alias("px")).select("*", "px.*")
    return shot.select(
        "event_id", F.round("f", 4).alias("ahead"), F.round("g", 4).alias("side"), F.round("h", 4).alias("down"), "u", "v",
        geo.in_image(F.col("u"), F.col("v"), 640, 512).alias("seen"),
    )


@query("""SELECT c_custkey, round(-greatest(c_acctbal - 160, 0) - 12.5, 4) AS depth, round((x*(1 + 0.1*q + 0.01*q*q) + 2*0.001*x*y + 0.002*(q + 2*x*x)), 6) AS lens_x
FROM (SELECT *, x*x + y*y AS q FROM (SELECT c_custkey, c_acctbal, c_nationkey / 25.0::DOUBLE AS x, c_acctbal / 20000.0::DOUBLE AS y FROM customer))""")
def g12_g17_depth_and_lens(spark, d):
    x, y = F.col("c_nationkey") / 25.0, F.col("c_acctbal") / 20000.0
    return table(spark, d, "customer").select(
        "c_custkey", F.round(geo.lifted(F.col("c_acctbal"), 160.0, F.lit(12.5)), 4).alias("depth"), r6(geo.distorted(x, y, (0.1, 0.01), (0.001, 0.002))["x"]).alias("lens_x")
    )


_DRAW = lambda n: f"CAST('0x' || substr(md5(concat_ws('|', 11, {n}, event_id)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query(f"""WITH n AS (SELECT s.sigma, s.sigma * sqrt(-2 * ln(1 - {_DRAW(0)})) * cos(6.283185307179586 * {_DRAW(1)}) AS e FROM events, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS sigma) s)
SELECT sigma, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS deviation FROM n GROUP BY sigma""")
def m07_sensor_noise(spark, d):
    """Mean and deviation of seeded noise for each sigma."""
    sigmas = experiments.grid(spark, {"sigma": [0.5, 1.0, 2.0]})
    noisy = table(spark, d, "events").select("event_id").crossJoin(sigmas).withColumn("e", experiments.noise(F.col("sigma"), F.col("event_id"), seed=11))
    return noisy.groupBy("sigma").agg(r6(F.avg("e")).alias("mean"), r6(F.stddev_samp("e")).alias("deviation"))
