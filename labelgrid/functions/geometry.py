"""Coordinates, poses and projection as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# WGS 84 and the transverse Mercator series in the third flattening.
_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3, 13 / 48 * _N**2 - 3 / 5 * _N**3, 61 / 240 * _N**3)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where value is reckoned once however often of names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def utm(lat: Column, lon: Column, epsg: int) -> Column:
    """Struct (x, y) in metres of degrees north and east, in a northern UTM zone (EPSG 326zz)."""
    zone = epsg - 32600
    if not 1 <= zone <= 60:
        raise ValueError(f"EPSG {epsg} is not a northern UTM zone")
    atanh = lambda v: F.lit(0.5) * F.ln((1 + v) / (1 - v))

    def sphere(p: Column) -> Column:
        angle = lambda t: F.struct(F.atan2(t, F.cos(p["lam"])).alias("xi"), atanh(F.sin(p["lam"]) / F.sqrt(1 + t * t)).alias("eta"))
        return _once(F.sinh(atanh(p["s"]) - F.lit(_ECC) * atanh(F.lit(_ECC) * p["s"])), angle)

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        x, y = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        scale = F.lit(0.9996 * _RADIUS)
        return F.struct((F.lit(500000.0) + scale * x).alias("x"), (scale * y).alias("y"))

    given = F.struct(F.sin(F.radians(lat)).alias("s"), F.radians(lon - F.lit(zone * 6.0 - 183.0)).alias("lam"))
    return _once(_once(given, sphere), plane)


# The inverse series, in the third flattening: from the plane to the conformal sphere, and from conformal to geodetic latitude.
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3, 1 / 48 * _N**2 + 1 / 15 * _N**3, 17 / 480 * _N**3)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3, 7 / 3 * _N**2 - 8 / 5 * _N**3, 56 / 15 * _N**3)


def lat_lon(x: Column, y: Column, epsg: int) -> Column:
    """Struct (lat, lon) in degrees of metres in a northern UTM zone (EPSG 326zz): what utm() undoes to well under a millimetre."""
    zone = epsg - 32600
    if not 1 <= zone <= 60:
        raise ValueError(f"EPSG {epsg} is not a northern UTM zone")
    scale = F.lit(0.9996 * _RADIUS)
    xi, eta = y / scale, (x - F.lit(500000.0)) / scale
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - F.lit(k) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(k) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, k in enumerate(_DELTA, 1):
        phi = phi + F.lit(k) * F.sin(2 * j * chi)
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(F.sinh(b), F.cos(a))) + F.lit(zone * 6.0 - 183.0)).alias("lon"))


def cell(x: Column, y: Column, x0: float, y0: float, res: float, height: int, width: int) -> Column:
    """Struct (row, col) of the nearest cell of a north-up grid; points outside go to its edge."""
    hold = lambda v, n: F.greatest(F.lit(0), F.least(F.floor(v).cast("long"), F.lit(n - 1))).cast("int")
    return F.struct(hold((F.lit(y0) - y) / F.lit(res), height).alias("row"), hold((x - F.lit(x0)) / F.lit(res), width).alias("col"))


def cell_centre(row: Column, col: Column, x0: float, y0: float, res: float) -> Column:
    return F.struct((F.lit(x0) + (col + F.lit(0.5)) * F.lit(res)).alias("x"), (F.lit(y0) - (row + F.lit(0.5)) * F.lit(res)).alias("y"))


def power_spacing(i: Column, n: int, start: float, end: float, exponent: float) -> Column:
    return F.lit(float(start)) + F.lit(float(end - start)) * F.pow(i.cast("double") / F.lit(float(n - 1)), F.lit(float(exponent)))


def world_grid(spark: SparkSession, nx: int = 250, ny: int = 200, reach: float = 10000.0, half: float = 50.0, y_mag: float = 8000.0) -> DataFrame:
    """(i, j, x, y): rays that widen with distance. The widening is cut to a whole number before it is cubed."""
    widest = int((y_mag / half) ** (1 / 3))
    i, j = F.col("i"), F.col("j")
    scale = F.lit(1.0) + F.lit(float(widest - 1)) * i / F.lit(float(nx - 1))
    grid = spark.range(nx).select(F.col("id").cast("int").alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("j")
    )
    line = F.lit(-half) + F.lit(2 * half) * j / F.lit(float(ny - 1))
    return grid.select("i", "j", power_spacing(i, nx, 0, reach, 3).alias("x"), (line * F.pow(scale, F.lit(3.0))).alias("y"))


def heading(yaw: Column) -> Column:
    """Unit vectors ahead and to the side of a yaw in radians."""
    return F.struct(F.cos(yaw).alias("ahead_x"), F.sin(yaw).alias("ahead_y"), (-F.sin(yaw)).alias("side_x"), F.cos(yaw).alias("side_y"))


def euler_zyx(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Struct (yaw, pitch, roll) in degrees of a quaternion, which need not be of unit length."""
    norm = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = (F.try_divide(v, norm) for v in (x, y, z, w))
    sine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))
    return F.struct(
        F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))).alias("yaw"),
        F.degrees(F.asin(sine)).alias("pitch"),
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).alias("roll"),
    )


def level_rotation(pitch: Column, roll: Column) -> list[list[Column]]:
    """Rotation of a camera without its yaw and with its roll turned round: pitch about y, then roll about x."""
    p, r = F.radians(pitch), F.radians(-roll)
    cp, sp, cr, sr = F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    return [[cp, sp * sr, sp * cr], [F.lit(0.0), cr, -sr], [-sp, cp * sr, cp * cr]]


def rotate(m: list[list[Column]], v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m)


def project(v: tuple[Column, Column, Column], camera: list[list[float]]) -> Column:
    """Struct (u, v) of whole pixels, cut towards zero; null for points in the plane of the camera.

    Axes turn from ahead-right-down to right-down-ahead first.
    """
    ahead, right, down = v
    h = (right, down, ahead, F.lit(1.0))
    a, b, c = (sum((F.lit(float(k)) * x for k, x in zip(row, h)), F.lit(0.0)) for row in camera)
    return F.struct(F.try_divide(a, c).try_cast("int").alias("u"), F.try_divide(b, c).try_cast("int").alias("v"))


def lifted(z: Column, baseline: float, altitude: Column) -> Column:
    """Height over the baseline, none below it, as depth under a camera at altitude."""
    return -F.greatest(z - F.lit(baseline), F.lit(0.0)) - altitude


def in_image(u: Column, v: Column, width: int, height: int) -> Column:
    """Whether a pixel counts as in the image: by magnitude, so negative pixels within it pass."""
    return (F.abs(u) < width) & (F.abs(v) < height)


def perspective(fov_y: float, aspect: float, near: float, far: float) -> list[list[float]]:
    f = 1 / math.tan(fov_y / 2)
    return [[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, (far + near) / (near - far), 2 * far * near / (near - far)], [0, 0, -1, 0]]


def orthographic(left: float, right: float, bottom: float, top: float, near: float, far: float) -> list[list[float]]:
    return [
        [2 / (right - left), 0, 0, -(right + left) / (right - left)], [0, 2 / (top - bottom), 0, -(top + bottom) / (top - bottom)],
        [0, 0, -2 / (far - near), -(far + near) / (far - near)], [0, 0, 0, 1],
    ]


def distorted(x: Column, y: Column, k: tuple[float, ...], p: tuple[float, float]) -> Column:
    """Radial and tangential lens model on normalised image coordinates."""
    r2 = x * x + y * y
    radial = F.lit(1.0)
    for n, c in enumerate(k, 1):
        radial = radial + F.lit(c) * F.pow(r2, F.lit(float(n)))
    p1, p2 = map(F.lit, p)
    return F.struct(
        (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)).alias("x"),
        (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y).alias("y"),
    )


def undistorted(x: Column, y: Column, k: tuple[float, ...], p: tuple[float, float], rounds: int = 20) -> Column:
    """Struct (x, y) of the point that distorted() takes to (x, y).

    Found by repeating: from a guess, what the lens adds there is taken off the point given. That settles where the lens
    bends little and evenly, as within an image. Points of a batch take the rounds together.
    """
    p1, p2 = p

    def back(given_x: pa.Array, given_y: pa.Array) -> pa.Array:
        none = pc.or_(given_x.is_null(), given_y.is_null()).to_numpy(zero_copy_only=False)
        x, y = (v.fill_null(0.0).to_numpy(zero_copy_only=False) for v in (given_x, given_y))
        u, v = x, y
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                r2 = u * u + v * v
                radial = np.zeros(len(r2))
                for c in reversed(k):
                    radial = (radial + c) * r2
                radial += 1.0
                u, v = (x - (2 * p1 * u * v + p2 * (r2 + 2 * u * u))) / radial, (y - (p1 * (r2 + 2 * v * v) + 2 * p2 * u * v)) / radial
        return pa.StructArray.from_arrays([pa.array(u, mask=none), pa.array(v, mask=none)], ["x", "y"])

    return F.arrow_udf(back, "struct<x: double, y: double>")(x.cast("double"), y.cast("double"))


def optimal_camera(camera: list[list[float]], k: tuple[float, ...], p: tuple[float, float], width: int, height: int, all_seen: float = 0.0, steps: int = 9) -> list[list[float]]:
    """The camera of an image without its lens's bending, of the same size.

    Points along and within the border are taken back through the lens. At 0 the view is the largest box inside them, so every
    pixel has a source; at 1 the box around them, so all of the image is seen; between, a mixture of both.
    """
    fx, fy, cx, cy = camera[0][0], camera[1][1], camera[0][2], camera[1][2]

    def back(x: float, y: float) -> tuple[float, float]:
        u, v = x, y
        for _ in range(50):
            r2 = u * u + v * v
            radial = 1 + sum(c * r2**n for n, c in enumerate(k, 1))
            u, v = (x - 2 * p[0] * u * v - p[1] * (r2 + 2 * u * u)) / radial, (y - p[0] * (r2 + 2 * v * v) - 2 * p[1] * u * v) / radial
        return u, v

    grid = [[back((j * (width - 1) / (steps - 1) - cx) / fx, (i * (height - 1) / (steps - 1) - cy) / fy) for j in range(steps)] for i in range(steps)]
    every = [q for row in grid for q in row]
    inner = (max(r[0][0] for r in grid), max(q[1] for q in grid[0]), min(r[-1][0] for r in grid), min(q[1] for q in grid[-1]))
    outer = (min(q[0] for q in every), min(q[1] for q in every), max(q[0] for q in every), max(q[1] for q in every))

    def fit(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
        a, b = (width - 1) / (box[2] - box[0]), (height - 1) / (box[3] - box[1])
        return a, b, -a * box[0], -b * box[1]

    a, b, c, d = ((1 - all_seen) * i + all_seen * o for i, o in zip(fit(inner), fit(outer)))
    return [[a, 0.0, c], [0.0, b, d], [0.0, 0.0, 1.0]]


def envelope(u: Column, points: list[tuple[Column, Column]]) -> Column:
    """Height at u of the line through points of growing u; flat beyond the ends."""
    out = points[-1][1]
    for (u0, v0), (u1, v1) in reversed(list(zip(points, points[1:]))):
        out = F.when(u <= u1, v0 + (u - u0) * (v1 - v0) / (u1 - u0)).otherwise(out)
    return F.when(u < points[0][0], points[0][1]).otherwise(out)


def at_place(place: Column, values: dict[str, float]) -> Column:
    """A place's fixed value; a place that has none is an error when it is read."""
    out = F.raise_error(F.concat(F.lit("no value for place "), F.coalesce(place, F.lit("null")))).cast("double")
    for name, value in values.items():
        out = F.when(place == name, F.lit(float(value))).otherwise(out)
    return out


def utm_bounds(south: Column, west: Column, north: Column, east: Column, epsg: int, steps: int = 20) -> Column:
    """Struct (x0, y0, x1, y1) in metres of a box in degrees: the extent of points along its four sides."""
    share = lambda k: k / F.lit(float(steps))
    every = F.sequence(F.lit(0), F.lit(steps))
    side = lambda lat, lon: F.transform(every, lambda k: utm(lat(share(k)), lon(share(k)), epsg))
    along = lambda a, b: lambda t: a + (b - a) * t
    still = lambda a: lambda t: a + 0 * t
    points = F.concat(
        side(still(south), along(west, east)), side(still(north), along(west, east)), side(along(south, north), still(west)), side(along(south, north), still(east))
    )
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def placed(x: Column, y: Column, yaw: Column, east: Column, north: Column) -> Column:
    """Struct (x, y) in metres of a grid point x ahead of and y beside a camera at (east, north) that looks along yaw."""
    h = heading(yaw)
    return F.struct((east + h["ahead_x"] * x + h["side_x"] * y).alias("x"), (north + h["ahead_y"] * x + h["side_y"] * y).alias("y"))


def grid_triangles(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """(triangle, a, b, c): two triangles for each cell of a grid whose point (i, j) has number i * ny + j."""
    i, j = F.floor(F.col("id") / (ny - 1)), F.col("id") % (ny - 1)
    first = i * ny + j
    return spark.range((nx - 1) * (ny - 1)).select(
        F.inline(F.array(
            F.struct((2 * F.col("id")).alias("triangle"), first.alias("a"), (first + 1).alias("b"), (first + ny).alias("c")),
            F.struct((2 * F.col("id") + 1).alias("triangle"), (first + 1).alias("a"), (first + ny + 1).alias("b"), (first + ny).alias("c")),
        ))
    )
