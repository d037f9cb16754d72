"""Band algebra; embeddings stand in for probability cubes."""

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import metrics
from ..registry import query, r6, table

_B = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_SOFT = f"""e AS (SELECT vec_id, label, {_B} AS b FROM embeddings),
x AS (SELECT vec_id, label, b, list_transform(b, lambda v: exp(v - list_max(b))) AS t FROM e),
s AS (SELECT vec_id, label, b, list_transform(t, lambda v: v / list_sum(t)) AS p FROM x)"""
_GROUPS = {k: k % 7 for k in range(63)} | {63: -1}


def soft(spark, d):
    b = arrays.doubles(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", "label", b.alias("b")).withColumn("p", arrays.softmax(F.col("b")))


@query(f"WITH e AS (SELECT vec_id, {_B} AS b FROM embeddings) SELECT vec_id, CAST(list_position(b, list_max(b)) - 1 AS INT) AS best FROM e")
def a23_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", arrays.argmax(arrays.doubles(F.col("embedding"))).alias("best"))


_MERGED = ", ".join(f"list_max([{', '.join(f'b[{s + 1}]' for s, g in _GROUPS.items() if g == k)}])" for k in range(7))


@query(f"""WITH e AS (SELECT vec_id, {_B} AS b FROM embeddings), m AS (SELECT vec_id, [{_MERGED}] AS m FROM e)
SELECT vec_id, CAST(list_position(m, list_max(m)) - 1 AS INT) AS label, round(list_max(m), 6) AS best, round(m[7], 6) AS last FROM m""")
def a22_r14_merged_bands(spark, d):
    m = table(spark, d, "embeddings").select("vec_id", arrays.group_max(arrays.doubles(F.col("embedding")), _GROUPS, 7).alias("m"))
    return m.select("vec_id", arrays.argmax(F.col("m")).alias("label"), r6(F.array_max("m")).alias("best"), r6(F.get("m", 6)).alias("last"))


@query(f"WITH {_SOFT} SELECT vec_id, round(p[1], 6) AS first, round(list_max(p), 6) AS top, round(list_sum(p), 6) AS total FROM s")
def x14_softmax(spark, d):
    return soft(spark, d).select("vec_id", r6(F.get("p", 0)).alias("first"), r6(F.array_max("p")).alias("top"), r6(arrays.total(F.col("p"))).alias("total"))


@query(f"""WITH {_SOFT}, l AS (SELECT vec_id, label, list_transform(p, lambda v, i: CASE WHEN label < 3 AND i = 1 THEN 0.5 ELSE ln(v + 1e-8) END) AS g FROM s),
x2 AS (SELECT vec_id, g, list_transform(g, lambda v: exp(v - list_max(g))) AS t FROM l),
s2 AS (SELECT vec_id, list_transform(t, lambda v: v / list_sum(t)) AS p FROM x2)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS best, round(p[1], 6) AS water FROM s2""")
def r18_water_correction(spark, d):
    fixed = soft(spark, d).select("vec_id", arrays.correct_water(F.col("p"), F.col("label") < 3).alias("p"))
    return fixed.select("vec_id", arrays.argmax(F.col("p")).alias("best"), r6(F.get("p", 0)).alias("water"))


@query(f"""WITH {_SOFT} SELECT CAST(vec_id % 5 AS INT) AS tile, round(-sum((1 + label % 2) * ln(p[label + 1])) / sum(1 + label % 2), 6) AS nll
FROM s WHERE label <> 3 GROUP BY 1""")
def a18_weighted_nll(spark, d):
    rows = soft(spark, d).withColumn("tile", (F.col("vec_id") % 5).cast("int"))
    weights = F.array(*[F.lit(1.0 + k % 2) for k in range(10)])
    return metrics.nll(rows, ["tile"], "p", "label", weights, ignore=3).withColumn("nll", r6("nll"))


@query(f"""WITH {_SOFT} SELECT vec_id, round(-ln(least(greatest(b[3], 0), 1) + 1e-3), 6) AS unary, round(least(greatest((b[4] - b[1]) / (b[4] + b[1] + 1e-7) + 1, 0), 2), 4) AS ndvi,
round((b[1] - 0.5) / 0.25, 6) AS standard FROM (SELECT vec_id, list_transform(b, lambda v: abs(v) + 0.1) AS b FROM s)""")
def r01_x13_x24_pixel_maths(spark, d):
    b = soft(spark, d).select("vec_id", F.transform("b", lambda v: F.abs(v) + F.lit(0.1)).alias("b"))
    three = arrays.standardise(F.slice("b", 1, 3), [0.5, 0.5, 0.5], [0.25, 0.25, 0.25])
    return b.select(
        "vec_id", r6(F.get(arrays.unary_potentials(F.col("b")), F.lit(2))).alias("unary"),
        F.round(arrays.ndvi(F.get("b", 3), F.get("b", 0)), 4).alias("ndvi"), r6(F.get(three, F.lit(0))).alias("standard"),
    )


@query(f"""WITH {_SOFT} SELECT vec_id, round((b[1] + b[64]) / 2, 6) AS mirrored, round(b[1] + p[1], 6) AS added, len(list_concat(b, p)) AS bands FROM s""")
def m04_u05_flip_average_and_stack(spark, d):
    both = arrays.mean_of(F.col("b"), F.reverse("b"))
    return soft(spark, d).select(
        "vec_id", r6(F.get(both, F.lit(0))).alias("mirrored"), r6(F.get(arrays.elementwise_sum(F.col("b"), F.col("p")), F.lit(0))).alias("added"),
        F.size(F.concat("b", "p")).cast("long").alias("bands"),
    )
