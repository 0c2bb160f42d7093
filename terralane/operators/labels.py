"""Label, pixel and prediction statistics over cell tables: one row per pixel or per prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

IGNORE = 255
# Class ids of the land-cover labels.
BUILDING, ROAD, CLASSES = 2, 3, range(1, 8)


def class_counts(cells: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """(*by, label, n); class 0 is no data and has rows of its own."""
    return cells.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def unknown_labels(cells: DataFrame, allowed: Sequence[int], by: str, label: str = "label") -> DataFrame:
    """(by, unknown) the labels outside the allowed ones, ascending."""
    return cells.where(~F.col(label).isin(*allowed)).groupBy(by).agg(F.array_sort(F.collect_set(label)).alias("unknown"))


def train_id(label: Column) -> Column:
    """Native class to training class: no data is ignored, the others count from 0."""
    return F.when(label == 0, F.lit(IGNORE)).otherwise(label - 1).cast("int")


def road_target(label: Column) -> Column:
    """struct<road, valid>."""
    return F.struct((label == ROAD).alias("road"), label.between(CLASSES.start, CLASSES.stop - 1).alias("valid"))


def resample_nearest(cells: DataFrame, sizes: DataFrame, size: int, by: str = "scene_id") -> DataFrame:
    """Labels on a size x size grid: cell i takes source cell floor(i * n / size). sizes has (scene, width, height)."""
    grid = sizes.select(by, "width", "height", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("ty")).select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("tx"))
    source = grid.select(by, "tx", "ty", F.floor(F.col("tx") * F.col("width") / size).cast("long").alias("x"), F.floor(F.col("ty") * F.col("height") / size).cast("long").alias("y"))
    return source.join(cells, [by, "x", "y"]).drop("x", "y").withColumnsRenamed({"tx": "x", "ty": "y"})


def class_weights(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Add weight: 1 / sqrt(n), scaled to a mean of 1. A class without pixels has no weight defined and is an error at use (null)."""
    raw = F.when(F.col(n) > 0, 1 / F.sqrt(n))
    total = counts.agg(F.avg(raw).alias("mean"), F.min(n).alias("least"))
    return counts.crossJoin(F.broadcast(total)).select(label, n, F.when(F.col("least") > 0, raw / F.col("mean")).alias("weight"))


def imbalance(cells: DataFrame, label: str = "label") -> DataFrame:
    """Road, other and ignored pixels, the road share of valid ones and the positive weight that balances them."""
    t = road_target(F.col(label))
    out = cells.agg(F.count_if(t["road"]).alias("road"), F.count_if(t["valid"] & ~t["road"]).alias("other"), F.count_if(~t["valid"]).alias("ignored"))
    return out.withColumn("road_share", F.col("road") / (F.col("road") + F.col("other"))).withColumn("positive_weight", F.col("other") / F.col("road"))


def inner_boundary(cells: DataFrame, width: int, mask: str = "mask", by: str = "scene_id") -> DataFrame:
    """Add boundary: mask cells with an outside cell within a square of `width`; beyond the image is outside.

    The square minimum is taken along rows, then along columns; a run shorter than the full square touches the image's
    border or an outside cell.
    """
    row = Window.partitionBy(by, "y").orderBy("x").rangeBetween(-width, width)
    col = Window.partitionBy(by, "x").orderBy("y").rangeBetween(-width, width)
    inside = F.col(mask).cast("int")
    rows = cells.withColumn("__r", F.when(F.count(F.lit(1)).over(row) == 2 * width + 1, F.min(inside).over(row)).otherwise(0))
    deep = F.when(F.count(F.lit(1)).over(col) == 2 * width + 1, F.min("__r").over(col)).otherwise(0)
    return rows.withColumn("boundary", F.col(mask) & (deep == 0)).drop("__r")


def hard_negative_weight(label: Column, boundary: Column, road: float, edge: float, building: float, normal: float = 1.0) -> Column:
    """Ignored pixels 0, then road, then building boundary, then building, then the rest."""
    return F.when(~road_target(label)["valid"], 0.0).when(label == ROAD, road).when(boundary, edge).when(label == BUILDING, building).otherwise(normal)


def confusion(preds: DataFrame, by: Sequence[str] = (), target: str = "target", pred: str = "pred") -> DataFrame:
    """(*by, target, pred, n) of predictions whose target isn't ignored."""
    return preds.where(F.col(target) != IGNORE).groupBy(*by, target, pred).agg(F.count(F.lit(1)).alias("n"))


def seg_metrics(counts: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Per class tp, fp, fn, iou, precision, recall, f1 of a confusion table; empty denominators count as 1."""
    rows = counts.groupBy(F.col(target).alias("class")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col(target) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    cols = counts.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("p"))
    out = rows.join(cols, "class", "full_outer").fillna(0)
    out = out.select("class", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"))
    return out.select("*", *binary_metrics("tp", "fp", "fn"))


def mean_metrics(per_class: DataFrame) -> DataFrame:
    """miou, mean_f1 and pixel_accuracy."""
    return per_class.agg(F.avg("iou").alias("miou"), F.avg("f1").alias("mean_f1"), (F.sum("tp") / F.greatest(F.sum(F.col("tp") + F.col("fn")), F.lit(1))).alias("pixel_accuracy"))


def binary_metrics(tp: str, fp: str, fn: str) -> list[Column]:
    """iou, precision, recall, f1 as columns."""
    tp, fp, fn = F.col(tp), F.col(fp), F.col(fn)
    over = lambda d: F.greatest(d, F.lit(1))
    return [(tp / over(tp + fp + fn)).alias("iou"), (tp / over(tp + fp)).alias("precision"), (tp / over(tp + fn)).alias("recall"), (2 * tp / over(2 * tp + fp + fn)).alias("f1")]


def argmax_class(logits: Column) -> Column:
    """Index of the largest logit, the first of equal ones."""
    return F.array_position(logits, F.array_max(logits)) - 1


def threshold_curve(preds: DataFrame, grid: Sequence[float], by: Sequence[str] = (), prob: str = "prob", target: str = "target") -> DataFrame:
    """tp, fp, fn, tn at each threshold of an ascending grid; a pixel is positive from the threshold on.

    Pixels are counted once by the number of thresholds that they reach; the counts at a threshold are sums of those
    buckets, so pixels never meet the grid.
    """
    reach = sum((F.when(F.col(prob) >= float(g), 1).otherwise(0) for g in grid), F.lit(0))
    hist = preds.groupBy(*by, reach.alias("bucket")).agg(F.sum(F.col(target).cast("long")).alias("pos"), F.count(F.lit(1)).alias("all"))
    table = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("k"), F.lit(float(g)).alias("threshold")) for i, g in enumerate(grid)))).alias("g")
    sums = hist.select(*by, "bucket", "pos", "all", table)
    up = F.col("bucket") >= F.col("g.k")
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sums.groupBy(*by, F.col("g.threshold").alias("threshold")).agg(
        s(F.when(up, F.col("pos"))).alias("tp"), s(F.when(up, F.col("all") - F.col("pos"))).alias("fp"), s(F.when(~up, F.col("pos"))).alias("fn"), s(F.when(~up, F.col("all") - F.col("pos"))).alias("tn")
    )


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, threshold, f1): the largest f1, of equal ones the threshold nearest to 0.5, then the lower one."""
    rows = curve.select(*by, "threshold", binary_metrics("tp", "fp", "fn")[3])
    order = F.struct("f1", -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return rows.groupBy(*by).agg(F.max_by("threshold", order).alias("threshold"), F.max("f1").alias("f1"))


def region_fp(preds: DataFrame, regions: Sequence[str], threshold: float, prob: str = "prob", target: str = "target") -> DataFrame:
    """(region, n, fp_rate, mean_prob) of negatives in each region; regions are boolean columns."""
    rows = preds.where(F.col(target) == 0).select(prob, F.explode(F.array_compact(F.array(*(F.when(F.col(r), r) for r in regions)))).alias("region"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(prob) >= threshold).cast("int")).alias("fp_rate"), F.avg(prob).alias("mean_prob"))


def hist_quantile(df: DataFrame, value: str, q: Sequence[float], bins: int = 1001, by: Sequence[str] = ()) -> DataFrame:
    """(*by, q, value) of values in [0, 1]: the first of the bins whose cumulative count reaches the share."""
    hist = df.groupBy(*by, F.floor(F.col(value) * (bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most `bins` rows a group
    hist = hist.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    rows = hist.select(*by, "bin", "cum", "total", F.explode(F.array(*(F.lit(float(x)) for x in q))).alias("q")).where(F.col("cum") >= F.col("q") * F.col("total"))
    return rows.groupBy(*by, "q").agg((F.min("bin") / (bins - 1)).alias("value"))


def bce_dice(preds: DataFrame, by: str, logit: str = "logit", target: str = "target", weight: str = "weight") -> DataFrame:
    """(by, bce, dice): weighted cross entropy of logits, and the soft Dice loss, over pixels with a weight."""
    z, y = F.col(logit), F.col(target).cast("double")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    p = 1 / (1 + F.exp(-z))
    rows = preds.where(F.col(weight) > 0)
    return rows.groupBy(by).agg((F.sum(loss * F.col(weight)) / F.sum(weight)).alias("bce"), (1 - (2 * F.sum(p * y) + 1) / (F.sum(p) + F.sum(y) + 1)).alias("dice"))


def guarded_select(history: DataFrame, by: str, baseline: float, tolerance: float, order: Sequence[Column], recall: str = "recall") -> DataFrame:
    """Per model the epoch with the least order values of those whose recall stays above baseline - tolerance."""
    ok = history.where(F.col(recall) >= baseline - tolerance)
    return ok.groupBy(by).agg(F.min_by("epoch", F.struct(*order, F.col("epoch"))).alias("epoch"), F.count(F.lit(1)).alias("passing"))


def guard_stop(history: DataFrame, by: str, baseline: float, tolerance: float, patience: int, recall: str = "recall") -> DataFrame:
    """Per model the first epoch at which the guardrail has failed `patience` times in a row; null where it never has."""
    w = Window.partitionBy(by).orderBy("epoch")
    fail = (F.col(recall) < baseline - tolerance).cast("int")
    rows = history.withColumn("fail", fail).withColumn("run", F.sum(1 - F.col("fail")).over(w))
    rows = rows.withColumn("length", F.sum("fail").over(Window.partitionBy(by, "run").orderBy("epoch")))
    return rows.groupBy(by).agg(F.min(F.when((F.col("fail") == 1) & (F.col("length") >= patience), F.col("epoch"))).alias("stop_epoch"))


def best_by(history: DataFrame, by: str, metric: str) -> DataFrame:
    """Per model the epoch with the largest metric, of equal ones the first."""
    return history.groupBy(by).agg(F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch"))).alias("epoch"), F.max(metric).alias(metric))


def early_stop(history: DataFrame, by: str, metric: str, patience: int) -> DataFrame:
    """Per model the first epoch by which the metric has not improved for `patience` epochs; null where it always has."""
    w = Window.partitionBy(by).orderBy("epoch")
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("better", (F.coalesce(F.col(metric) > before, F.lit(True))).cast("int"))
    rows = rows.withColumn("run", F.sum("better").over(w)).withColumn("since", F.row_number().over(Window.partitionBy(by, "run").orderBy("epoch")) - 1)
    return rows.groupBy(by).agg(F.min(F.when(F.col("since") >= patience, F.col("epoch"))).alias("stop_epoch"))


def seed_summary(metrics: DataFrame, by: Sequence[str], values: Sequence[str], most: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation of each value, and the maximum of others."""
    return metrics.groupBy(*by).agg(*(f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))), *(F.max(v).alias(f"{v}_max") for v in most))


def per_class(metrics: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Long form (*by, class, value) of one column per class."""
    return metrics.unpivot(list(by), list(classes), "class", "value")


def per_class_wide(long: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    return long.groupBy(*by).pivot("class", list(classes)).agg(F.avg("value"))


def delta(a: DataFrame, b: DataFrame, key: Sequence[str], value: str, goal: float | None = None) -> DataFrame:
    """(*key, a, b, absolute, relative[, gap]): b against a, and what is left to a goal."""
    out = a.select(*key, F.col(value).alias("a")).join(b.select(*key, F.col(value).alias("b")), list(key))
    out = out.withColumn("absolute", F.col("b") - F.col("a")).withColumn("relative", F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a")))
    return out if goal is None else out.withColumn("gap", F.lit(goal) - F.col("b"))


def prob_delta(a: DataFrame, b: DataFrame, key: Sequence[str], value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Statistics of b - a over cells that both have."""
    d = F.col("vb") - F.col("va")
    rows = a.select(*key, F.col(value).alias("va")).join(b.select(*key, F.col(value).alias("vb")), list(key))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.avg(F.abs(d)).alias("mean_abs"), *(F.percentile(F.abs(d), F.lit(p / 100)).alias(f"p{p}_abs") for p in (10, 50, 90, 99)), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b")
    )


def top_windows(cells: DataFrame, size: int, stride: int, k: int, value: str = "value", by: str = "scene_id") -> DataFrame:
    """The k windows of each scene with the largest mean; windows start at multiples of the stride, full ones only by the extent of the cells."""
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / stride)).cast("int")
    origins = lambda c: F.transform(F.sequence(first(c), F.floor(F.col(c) / stride).cast("int")), lambda i: i * stride)
    rows = cells.select(by, value, F.explode(origins("x")).alias("wx"), "y").select(by, value, "wx", F.explode(origins("y")).alias("wy"))
    extent = cells.groupBy(by).agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    means = rows.groupBy(by, "wx", "wy").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).join(extent, by)
    means = means.where((F.col("wx") + size - 1 <= F.col("mx")) & (F.col("wy") + size - 1 <= F.col("my")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("mean", 12)), "wy", "wx"))
    return means.withColumn("rank", rank).where(F.col("rank") <= k).select(by, "rank", "wx", "wy", "mean")


def prob_stats(cells: DataFrame, threshold: float, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, extremes, quantiles and the number over a threshold."""
    return cells.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), *(F.percentile(value, F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)), F.count_if(F.col(value) > threshold).alias("above")
    )


def positive_ratio(cells: DataFrame, threshold: float, by: Sequence[str], value: str = "value") -> DataFrame:
    return cells.groupBy(*by).agg(F.avg((F.col(value) > threshold).cast("int")).alias("ratio"))


def disk_mean(points: DataFrame, cells: DataFrame, radius: int, by: Sequence[str] = ("scene_id",), value: str = "value") -> DataFrame:
    """(*by, id, n, mean) of the cells within a radius of each point's nearest cell."""
    r = range(-radius, radius + 1)
    disk = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in r for j in r if i * i + j * j <= radius * radius))).alias("o")
    at = points.select(*by, "id", F.rint("x").cast("long").alias("px"), F.rint("y").cast("long").alias("py"), disk)
    at = at.select(*by, "id", (F.col("px") + F.col("o.i")).alias("x"), (F.col("py") + F.col("o.j")).alias("y"))
    return at.join(cells, [*by, "x", "y"]).groupBy(*by, "id").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
