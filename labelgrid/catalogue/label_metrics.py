"""Confusion matrices, IoU, votes and losses; labels and lineitem stand in for label masks."""

from pyspark.sql import functions as F

from ..functions import taxonomy
from ..operators import metrics, raster
from ..registry import query, r6, table

_GT = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_CM = f"cm AS (SELECT l_linestatus AS run, {_GT} AS gt, CAST(l_suppkey % 3 AS INT) AS pred, count(*) AS n FROM lineitem GROUP BY ALL)"
_COUNTS = """c AS (SELECT run, k AS class,
 sum(CASE WHEN gt = k AND pred = k THEN n ELSE 0 END) AS tp, sum(CASE WHEN gt = k THEN n ELSE 0 END) AS n_gt,
 sum(CASE WHEN pred = k THEN n ELSE 0 END) AS n_pred FROM cm, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY run, k)"""
_IOU = "CASE WHEN n_gt + n_pred - tp = 0 THEN NULL ELSE CAST(tp AS DOUBLE) / CAST(n_gt + n_pred - tp AS DOUBLE) END"


def masks(spark, d, *more):
    gt = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, d, "lineitem").select(F.col("l_linestatus").alias("run"), gt.alias("gt"), (F.col("l_suppkey") % 3).cast("int").alias("pred"), *more)


def matrices(spark, d):
    return metrics.confusion(masks(spark, d), ["run"], k=3)


@query(f"WITH {_CM} SELECT run, gt, pred, n FROM cm")
def a01_confusion_matrix(spark, d):
    return matrices(spark, d)


@query("SELECT quality AS gt, toxic AS pred, count(*) AS n FROM labels WHERE quality BETWEEN 0 AND 1 GROUP BY ALL")
def a01_confusion_labels(spark, d):
    return metrics.confusion(table(spark, d, "labels"), [], "quality", "toxic", 2)


@query(f"""WITH {_CM}, g AS (SELECT DISTINCT run FROM cm), k AS (SELECT unnest([0, 1, 2, 3]) AS i)
SELECT g.run, a.i AS gt, b.i AS pred, coalesce(cm.n, 0) AS n FROM g, k a, k b LEFT JOIN cm ON cm.run = g.run AND cm.gt = a.i AND cm.pred = b.i""")
def a01_dense_confusion(spark, d):
    return metrics.dense(matrices(spark, d), ["run"], 4)


@query(f"WITH {_CM}, {_COUNTS} SELECT run, class, round(coalesce({_IOU}, 0), 6) AS iou FROM c")
def a02_iou_zero_fill(spark, d):
    return metrics.iou_per_class(matrices(spark, d), ["run"], 4, "zero").withColumn("iou", r6("iou"))


@query(f"WITH {_CM}, {_COUNTS} SELECT run, class, round({_IOU}, 6) AS iou FROM c WHERE {_IOU} IS NOT NULL")
def a03_iou_present(spark, d):
    return metrics.iou_per_class(matrices(spark, d), ["run"], 4, "drop").withColumn("iou", r6("iou"))


@query(f"WITH {_CM}, {_COUNTS} SELECT run, class, round({_IOU}, 6) AS iou FROM c")
def a03b_iou_kept(spark, d):
    return metrics.iou_per_class(matrices(spark, d), ["run"], 4, "keep").withColumn("iou", r6("iou"))


@query(f"WITH {_CM}, {_COUNTS} SELECT run, round(avg(coalesce({_IOU}, 0)), 6) AS miou_zero_fill, round(avg({_IOU}), 6) AS miou_present FROM c GROUP BY run")
def a04_miou(spark, d):
    both = metrics.miou_both(matrices(spark, d), ["run"], 4)
    return both.select("run", r6("miou_zero_fill").alias("miou_zero_fill"), r6("miou_present").alias("miou_present"))


@query("""SELECT o_orderkey, o_orderpriority, count(o_totalprice) OVER w AS group_count, round(avg(o_totalprice) OVER w, 4) AS group_mean,
round(stddev_samp(o_totalprice) OVER w, 4) AS group_std FROM orders WINDOW w AS (PARTITION BY o_orderpriority, o_orderstatus)""")
def a05_group_stats(spark, d):
    out = metrics.group_stats(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return out.select("o_orderkey", "o_orderpriority", "group_count", F.round("group_mean", 4).alias("group_mean"), F.round("group_std", 4).alias("group_std"))


@query(f"""WITH r AS (SELECT l_linestatus AS run, CAST(l_linenumber AS INT) AS part, {_GT} AS gt, CAST(l_suppkey % 3 AS INT) AS pred, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT unnest([0, 1, 2]) AS k),
p AS (SELECT run, part, k, sum(CASE WHEN gt = k AND pred = k THEN n ELSE 0 END) AS tp, sum(CASE WHEN gt = k OR pred = k THEN n ELSE 0 END) AS u FROM r, k GROUP BY ALL),
s AS (SELECT run, k, sum(tp) AS tp, sum(u) AS u FROM p GROUP BY ALL),
micro AS (SELECT run, avg(CASE WHEN u > 0 THEN CAST(tp AS DOUBLE) / CAST(u AS DOUBLE) END) AS m FROM s GROUP BY run),
macro AS (SELECT run, avg(m) AS m FROM (SELECT run, part, avg(CASE WHEN u > 0 THEN CAST(tp AS DOUBLE) / CAST(u AS DOUBLE) END) AS m FROM p GROUP BY run, part) GROUP BY run)
SELECT micro.run, round(micro.m, 6) AS miou_total, round(macro.m, 6) AS trajectory_avg_miou FROM micro JOIN macro ON micro.run = macro.run""")
def a06_micro_and_macro(spark, d):
    cm = metrics.confusion(masks(spark, d, F.col("l_linenumber").cast("int").alias("part")), ["run", "part"], k=3)
    out = metrics.micro_and_macro(cm, ["run", "part"], ["run"], 3)
    return out.select("run", r6("miou_total").alias("miou_total"), r6("trajectory_avg_miou").alias("trajectory_avg_miou"))


@query("""WITH s AS (SELECT vec_id, CASE WHEN vec_id % 50 < 49 THEN CAST(vec_id % 50 AS INT) END AS segment, label FROM embeddings),
v AS (SELECT segment, label AS vote, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, label) AS r FROM s GROUP BY segment, label)
SELECT s.vec_id, s.segment, s.label, v.vote FROM s JOIN v ON s.segment IS NOT DISTINCT FROM v.segment AND v.r = 1""")
def a10_segment_vote(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 < 49, (F.col("vec_id") % 50).cast("int")).alias("segment"), "label")
    return metrics.segment_vote(rows, ["segment"], "label").select("vec_id", "segment", "label", "vote")


@query("""WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)
SELECT p_type, n, round(max(n) OVER () / n, 2) AS weight FROM c""")
def a12_a13_label_weights(spark, d):
    return metrics.inverse_frequency_weights(metrics.label_counts(table(spark, d, "part"), "p_type")).withColumn("weight", F.round("weight", 2))


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999, round(avg(l_extendedprice) + stddev_pop(l_extendedprice), 4) AS threshold
FROM lineitem GROUP BY l_returnflag""")
def a14_a15_clip_and_threshold(spark, d):
    rows, x = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), F.col("l_extendedprice")
    threshold = rows.groupBy("l_returnflag").agg(F.round(F.avg(x) + F.stddev_pop(x), 4).alias("threshold"))
    top = metrics.exact_percentile(rows, ["l_returnflag"], "l_extendedprice", 0.999, "p999")
    return top.select("l_returnflag", r6("p999").alias("p999")).join(threshold, "l_returnflag")


@query(f"""WITH t AS (SELECT l_orderkey, {_GT} AS gt, CAST(l_partkey % 3 AS INT) AS pred FROM lineitem)
SELECT l_orderkey, CASE WHEN min(gt) = max(gt) AND min(pred) = max(pred) THEN CASE WHEN min(gt) = min(pred) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS loss FROM t GROUP BY l_orderkey""")
def a19_uniform_tile_loss(spark, d):
    gt = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    t = table(spark, d, "lineitem").select("l_orderkey", gt.alias("gt"), (F.col("l_partkey") % 3).cast("int").alias("pred"))
    return metrics.uniform_tile_loss(t, ["l_orderkey"], "gt", "pred")


def _case(pairs):
    return "CASE label " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs.items()) + " END"


_DW = taxonomy.index_map(taxonomy.DYNAMIC_WORLD, taxonomy.DYNAMIC_WORLD_TO_COMMON, taxonomy.COMMON)
_GT_MOST = taxonomy.index_map(taxonomy.GROUND_TRUTH, taxonomy.GROUND_TRUTH_TO_COMMON, taxonomy.MOST_COMMON)


@query(f"""WITH e AS (SELECT vec_id, CASE WHEN label = 9 THEN 255 ELSE label END AS label FROM embeddings)
SELECT vec_id, {_case(_DW)} AS common, CASE WHEN {_case(_DW)} = -1 THEN 255 ELSE {_case(_DW)} END AS stored,
coalesce({_case(taxonomy.DYNAMIC_WORLD_TO_SATELLITE)}, label) AS kept FROM e""")
def j05_r15_r16_taxonomy_remap(spark, d):
    label = F.when(F.col("label") == 9, 255).otherwise(F.col("label"))
    return table(spark, d, "embeddings").select(
        "vec_id", taxonomy.remap(label, _DW).alias("common"), taxonomy.remap_strict(label, _DW).alias("stored"),
        taxonomy.remap_keeping(label, taxonomy.DYNAMIC_WORLD_TO_SATELLITE).alias("kept"),
    )


@query(f"""WITH e AS (SELECT vec_id, CAST(vec_id % 12 AS INT) AS code, label AS pred FROM embeddings)
SELECT vec_id, greatest(code - 2, -1) AS gt, greatest(code - 2, 0) AS gt_prediction_rule, CASE WHEN pred = 0 THEN 255 ELSE pred - 1 END AS rendered,
CASE WHEN pred > 6 THEN -1 ELSE pred END AS in_domain, CASE WHEN code = 3 THEN 0 ELSE code END AS first_class FROM e""")
def r17_r20_r21_f09_label_codes(spark, d):
    code = (F.col("vec_id") % 12).cast("int")
    return table(spark, d, "embeddings").select(
        "vec_id", raster.gt_offset(code).alias("gt"), raster.gt_offset(code, True).alias("gt_prediction_rule"),
        raster.unrendered_to_sky(F.col("label")).alias("rendered"), raster.out_of_domain(F.col("label"), 6).alias("in_domain"),
        raster.ignored_to_first(code, 3).alias("first_class"),
    )


@query("""SELECT CAST(x AS INT) AS label FROM (SELECT unnest(range(0, (SELECT max(label) + 1 FROM embeddings WHERE label <> 4))) AS x)
WHERE x NOT IN (SELECT label FROM embeddings WHERE label <> 4)""")
def u02_missing_indices(spark, d):
    return taxonomy.missing_indices(table(spark, d, "embeddings").where("label <> 4").select("label"), "label")


@query("""SELECT * FROM (VALUES (0, 'water'), (1, 'low_vegetation, trees'), (2, 'built'), (3, 'ground'), (4, 'sky')) t(idx, names)""")
def a28_names_by_index(spark, d):
    return taxonomy.names_by_index(taxonomy.MORE_COMMON, spark)
