"""Confusion matrices in long form (keys, gt, pred, n) and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import with_groups


def confusion(rows: DataFrame, keys: list[str], gt: str = "gt", pred: str = "pred", k: int | None = None) -> DataFrame:
    """Counts of (gt, pred) for each key; targets outside 0 to k-1 are ignored."""
    if k is not None:
        rows = rows.where(F.col(gt).between(0, k - 1))
    return rows.groupBy(*keys, F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def dense(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """All k*k cells of each key's matrix, zeros included."""
    axis = F.sequence(F.lit(0), F.lit(k - 1))
    grid = cm.select(*keys).distinct().withColumn("gt", F.explode(axis)).select("*", F.explode(axis).alias("pred"))
    return grid.join(cm, [*keys, "gt", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _wide_counts(cm: DataFrame, keys: list[str], k: int, *more: Column) -> DataFrame:
    """One row per key: arrays tp, n_gt and n_pred over the classes 0 to k-1, made in one pass over the cells."""
    gt, pred, n = F.col("gt"), F.col("pred"), F.col("n")

    def sums(holds) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(holds(c), n)), F.lit(0)) for c in range(k)])

    return cm.groupBy(*keys).agg(
        sums(lambda c: (gt == c) & (pred == c)).alias("tp"), sums(lambda c: gt == c).alias("n_gt"), sums(lambda c: pred == c).alias("n_pred"), *more
    )


def class_counts(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, class, tp, n_gt, n_pred) for classes 0 to k-1 of each key that cm has."""
    rows = F.arrays_zip(F.sequence(F.lit(0), F.lit(k - 1)).alias("class"), "tp", "n_gt", "n_pred")
    return _wide_counts(cm, keys, k).select(*keys, F.inline(rows)).toDF(*keys, "class", "tp", "n_gt", "n_pred")


def _ious() -> Column:
    """Array of the classes' IoU over the arrays of _wide_counts(); null for a class in neither gt nor pred."""
    return F.transform(
        F.arrays_zip("tp", "n_gt", "n_pred"), lambda x: F.try_divide(x["tp"].cast("double"), (x["n_gt"] + x["n_pred"] - x["tp"]).cast("double"))
    )


def _mean(values: Column) -> Column:
    """Mean of an array's elements that are not null; null where there are none."""
    there = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there))


def iou_per_class(cm: DataFrame, keys: list[str], k: int, absent: str = "zero") -> DataFrame:
    """(keys, class, iou). A class in neither gt nor pred: 0 (zero), no row (drop) or null (keep)."""
    ratio = F.try_divide(F.col("tp").cast("double"), (F.col("n_gt") + F.col("n_pred") - F.col("tp")).cast("double"))
    out = class_counts(cm, keys, k).select(*keys, "class", ratio.alias("iou"))
    if absent == "zero":
        return out.withColumn("iou", F.coalesce("iou", F.lit(0.0)))
    return out.where(F.col("iou").isNotNull()) if absent == "drop" else out


def miou_both(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, miou_zero_fill, miou_present): classes in neither gt nor pred count 0, or are left out."""
    filled = F.transform(_ious(), lambda x: F.coalesce(x, F.lit(0.0)))
    return _wide_counts(cm, keys, k).select(*keys, _mean(filled).alias("miou_zero_fill"), _mean(_ious()).alias("miou_present"))


def miou_zero_fill(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    return miou_both(cm, keys, k).select(*keys, F.col("miou_zero_fill").alias("miou"))


def miou_present(cm: DataFrame, keys: list[str], k: int) -> DataFrame:
    return miou_both(cm, keys, k).select(*keys, F.col("miou_present").alias("miou"))


def summed(cm: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of the matrices of a coarser key."""
    return cm.groupBy(*keys, "gt", "pred").agg(F.sum("n").alias("n"))


def micro_and_macro(cm: DataFrame, run: list[str], keys: list[str], k: int) -> DataFrame:
    """For each coarser key: mIoU of the summed matrix, and the mean of its runs' mIoU. cm is read once."""
    runs = _wide_counts(cm, run, k).withColumn("__miou", _mean(_ious()))

    def sums(c: str) -> Column:
        return F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(k)]).alias(c)

    added = runs.groupBy(*keys).agg(sums("tp"), sums("n_gt"), sums("n_pred"), F.avg("__miou").alias("trajectory_avg_miou"))
    return added.select(*keys, _mean(_ious()).alias("miou_total"), "trajectory_avg_miou")


def group_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row with its group's count, mean and sample deviation of value; null keys are a group of their own.

    Groups are aggregated and joined back, so no task holds a group's rows.
    """
    groups = rows.groupBy(*keys).agg(
        F.count(value).alias("group_count"), F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_std")
    )
    return with_groups(rows, groups, keys)


def exact_percentile(rows: DataFrame, keys: list[str], value: str, p: float, name: str, bins: int = 1024) -> DataFrame:
    """(keys, name): the interpolated percentile p of value; nulls are left out.

    Twice the range that holds the two ranks asked for is cut to bins and narrowed to theirs by counts;
    only what lies there, about a millionth of the range, is counted value by value. No task or buffer
    holds a group.
    """
    values = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    v = F.col("__v")
    state = values.groupBy(*keys).agg(F.count("__v").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    rank = (F.col("__n") - 1) * F.lit(float(p))
    state = state.select(*keys, F.floor(rank).alias("__a"), F.ceil(rank).alias("__b"), (rank - F.floor(rank)).alias("__w"), "__low", "__high", F.lit(0).cast("long").alias("__below"))
    kept = [*keys, "__a", "__b", "__w"]
    before = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def ranked(cells: DataFrame, order: str) -> DataFrame:
        """cells (…, __m) that hold one of the two ranks, with how many values lie before each."""
        start = F.col("__below") + F.coalesce(F.sum("__m").over(before(order)), F.lit(0))
        placed = cells.withColumn("__start", start)
        holds = lambda r: (F.col("__start") <= F.col(r)) & (F.col(r) < F.col("__start") + F.col("__m"))
        return placed.where(holds("__a") | holds("__b"))

    for _ in range(2):
        inside = with_groups(values, state, keys).where(v.between(F.col("__low"), F.col("__high")))
        share = F.try_divide(v - F.col("__low"), F.col("__high") - F.col("__low"))
        cell = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
        cells = inside.groupBy(*kept, "__below", cell.alias("__cell")).agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        state = ranked(cells, "__cell").groupBy(*kept).agg(F.min("__lo").alias("__low"), F.max("__hi").alias("__high"), F.min("__start").alias("__below"))
    inside = with_groups(values, state, keys).where(v.between(F.col("__low"), F.col("__high")))
    counts = ranked(inside.groupBy(*kept, "__below", "__v").agg(F.count(F.lit(1)).alias("__m")), "__v")
    return counts.groupBy(*keys, "__w").agg(F.min("__v").alias("__x"), F.max("__v").alias("__y")).select(
        *keys, (F.col("__x") + F.col("__w") * (F.col("__y") - F.col("__x"))).alias(name)
    )


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency_weights(counts: DataFrame) -> DataFrame:
    """weight: the largest count over this one."""
    top = counts.agg(F.max("n").alias("top"))
    return counts.crossJoin(F.broadcast(top)).withColumn("weight", F.col("top") / F.col("n")).drop("top")


def segment_vote(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Every row with its segment's most frequent label as vote; the smallest of equals. Null keys are a segment."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*keys).agg(F.max_by(label, F.struct("__n", -F.col(label))).alias("vote"))
    return with_groups(rows, best, keys)


def nll(rows: DataFrame, keys: list[str], probs: str, gt: str, weights: Column | None = None, ignore: int = -1) -> DataFrame:
    """Weighted mean of -ln(probability of gt) over rows whose gt is not ignored."""
    kept = rows.where(F.col(gt) != ignore)
    w = F.lit(1.0) if weights is None else F.get(weights, F.col(gt))
    return kept.groupBy(*keys).agg(F.try_divide(-F.sum(w * F.ln(F.get(F.col(probs), F.col(gt)))), F.sum(w)).alias("nll"))


def uniform_tile_loss(rows: DataFrame, tile: list[str], gt: str, pred: str, ignore: int = -1) -> DataFrame:
    """Loss of tiles where both labels are uniform: 0 if equal, 1 if not; null for other tiles."""
    kept = rows.where(F.col(gt) != ignore).groupBy(*tile).agg(
        F.min(gt).alias("a"), F.max(gt).alias("b"), F.min(pred).alias("c"), F.max(pred).alias("d")
    )
    loss = F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.when(F.col("a") == F.col("c"), 0.0).otherwise(1.0))
    return kept.select(*tile, loss.alias("loss"))


def boundary_f1(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, boundary_metric): mean over classes of 1 - F1 from tp, tpfp, tn, tnfn; lower is better.

    sums has a row per key and class: tp and tpfp sum predicted boundary inside the widened true one
    and in all, tn and tnfn true boundary inside the widened predicted one and in all.
    """
    eps = F.lit(1e-7)
    p, r = F.col("tp") / (F.col("tpfp") + eps), F.col("tn") / (F.col("tnfn") + eps)
    f1 = 2 * p * r / (p + r + eps)
    return sums.groupBy(*keys).agg(F.avg(1 - f1).alias("boundary_metric"))
