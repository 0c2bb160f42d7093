"""Label and prediction queries over labels, documents, embeddings, lineitem cells and orders history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import labels as op
from .inputs import CELLS, HISTORY, PRED, cells, history, predictions, rounded

GRID = [round(0.05 * i, 2) for i in range(1, 20)]
#: Cells with a class 0 to 7.
LAND = CELLS + ", land AS (SELECT x, y, value, CAST((x * 7 + y * 3) % 8 AS INT) AS label, (x + y) % 4 AS scene_id FROM cells)"
CURVE = PRED + ", gr AS (SELECT unnest([" + ", ".join(map(str, GRID)) + "]) AS threshold), cu AS (SELECT threshold, sum(CASE WHEN prob >= threshold THEN target ELSE 0 END) AS tp, sum(CASE WHEN prob >= threshold THEN 1 - target ELSE 0 END) AS fp, sum(CASE WHEN prob < threshold THEN target ELSE 0 END) AS fn, sum(CASE WHEN prob < threshold THEN 1 - target ELSE 0 END) AS tn FROM pr, gr GROUP BY 1)"


def land(t):
    return cells(t).withColumn("label", ((F.col("x") * 7 + F.col("y") * 3) % 8).cast("int")).withColumn("scene_id", (F.col("x") + F.col("y")) % 4)


def scored(t):
    return predictions(t).withColumn("prob", F.col("prob"))


@query("c1_class_counts", f"WITH {LAND} SELECT scene_id, label, count(*) AS n FROM land GROUP BY 1, 2")
def _(t):
    return op.class_counts(land(t), ["scene_id"])


@query("c2_unknown_labels", f"WITH {LAND} SELECT scene_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS unknown FROM land WHERE label NOT IN (0, 1, 2, 3) GROUP BY 1")
def _(t):
    return op.unknown_labels(land(t), [0, 1, 2, 3], "scene_id").select("scene_id", F.array_join(F.col("unknown").cast("array<string>"), ",").alias("unknown"))


@query("c3_train_id", f"WITH {LAND} SELECT x, y, CASE WHEN label = 0 THEN 255 ELSE label - 1 END AS train_id FROM land")
def _(t):
    return land(t).select("x", "y", op.train_id(F.col("label")).alias("train_id"))


@query("c4_road_target", f"WITH {LAND} SELECT x, y, label = 3 AS road, label BETWEEN 1 AND 7 AS valid FROM land")
def _(t):
    return land(t).select("x", "y", op.road_target(F.col("label")).alias("t")).select("x", "y", "t.road", "t.valid")


@query("c5_resample_nearest", f"WITH {LAND}, q AS (SELECT tx.i AS x, ty.i AS y FROM range(0, 48) tx(i), range(0, 48) ty(i)) SELECT 0 AS scene_id, q.x, q.y, label FROM q JOIN land l ON l.x = floor(q.x * (SELECT max(x) + 1 FROM cells) / 48) AND l.y = floor(q.y * (SELECT max(y) + 1 FROM cells) / 48)")
def _(t):
    one = land(t).withColumn("scene_id", F.lit(0))
    sizes = one.groupBy("scene_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return op.resample_nearest(one, sizes, 48).select("scene_id", "x", "y", "label")


@query("c6_class_weights", f"WITH {LAND}, c AS (SELECT label, count(*) AS n FROM land WHERE label > 0 GROUP BY 1) SELECT label, n, round(1 / sqrt(n) / (SELECT avg(1 / sqrt(n)) FROM c), 6) AS weight FROM c")
def _(t):
    return rounded(op.class_weights(op.class_counts(land(t).where("label > 0"), [])))


@query("c7_imbalance", f"WITH {LAND}, c AS (SELECT count(*) FILTER (label = 3) AS road, count(*) FILTER (label NOT IN (0, 3)) AS other, count(*) FILTER (label = 0) AS ignored FROM land) SELECT *, round(road / (road + other), 6) AS road_share, round(other / road, 6) AS positive_weight FROM c")
def _(t):
    return rounded(op.imbalance(land(t)))


@query("c8_inner_boundary", f"""WITH {LAND}, m AS (SELECT x, y, x BETWEEN 0 AND 40 AND y BETWEEN 10 AND 50 AND value > 0.3 AS mask FROM land)
SELECT a.x, a.y, a.mask, a.mask AND (count(*) < 25 OR NOT bool_and(b.mask)) AS boundary FROM m a JOIN m b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.x, a.y, a.mask""")
def _(t):
    m = land(t).select("x", "y", (F.col("x").between(0, 40) & F.col("y").between(10, 50) & (F.col("value") > 0.3)).alias("mask"), F.lit(0).alias("scene_id"))
    return op.inner_boundary(m, 2).select("x", "y", "mask", "boundary")


@query("c9_pixel_weights", f"WITH {LAND} SELECT x, y, CASE WHEN label = 0 THEN 0.0 WHEN label = 3 THEN 1.0 WHEN value > 0.5 THEN 4.0 WHEN label = 2 THEN 2.0 ELSE 1.5 END AS weight FROM land")
def _(t):
    return land(t).select("x", "y", op.hard_negative_weight(F.col("label"), F.col("value") > 0.5, 1.0, 4.0, 2.0, 1.5).alias("weight"))


@query("c10_confusion", f"WITH {PRED} SELECT lang, target, pred, count(*) AS n FROM pr GROUP BY ALL")
def _(t):
    return op.confusion(predictions(t), ["lang"])


METRICS = """s AS (SELECT c AS class, sum(CASE WHEN target = c AND pred = c THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN target <> c AND pred = c THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN target = c AND pred <> c THEN 1 ELSE 0 END) AS fn FROM pr, (VALUES (0), (1)) v(c) GROUP BY 1),
k AS (SELECT *, tp / greatest(tp + fp + fn, 1) AS iou, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM s)"""


@query("c11_seg_metrics", f"WITH {PRED}, {METRICS} SELECT class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k")
def _(t):
    return rounded(op.seg_metrics(op.confusion(predictions(t))))


@query("c11_mean_metrics", f"WITH {PRED}, {METRICS} SELECT round(avg(iou), 6) AS miou, round(avg(f1), 6) AS mean_f1, round(sum(tp) / sum(tp + fn), 6) AS pixel_accuracy FROM k")
def _(t):
    return rounded(op.mean_metrics(op.seg_metrics(op.confusion(predictions(t)))))


@query("c12_argmax_class", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS class FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", op.argmax_class(F.col("embedding")).alias("class"))


@query("c13_threshold_curve", f"WITH {CURVE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn FROM cu")
def _(t):
    return op.threshold_curve(predictions(t), GRID)


@query("c14_binary_metrics", f"WITH {CURVE} SELECT threshold, round(tp / greatest(tp + fp + fn, 1), 6) AS iou, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM cu")
def _(t):
    return rounded(op.threshold_curve(predictions(t), GRID).select("threshold", *op.binary_metrics("tp", "fp", "fn")))


@query("c15_best_threshold", f"WITH {CURVE}, f AS (SELECT threshold, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM cu) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, abs(threshold - 0.5), threshold LIMIT 1")
def _(t):
    return rounded(op.best_threshold(op.threshold_curve(predictions(t), GRID)))


@query("c16_region_fp", f"WITH {PRED} SELECT region, count(*) AS n, round(avg(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END), 6) AS fp_rate, round(avg(prob), 6) AS mean_prob FROM (SELECT prob, 'building' AS region FROM pr WHERE target = 0 AND lang = 'en' UNION ALL SELECT prob, 'boundary' FROM pr WHERE target = 0 AND doc_id % 3 = 0) GROUP BY 1")
def _(t):
    p = predictions(t).withColumn("building", F.col("lang") == "en").withColumn("boundary", F.col("doc_id") % 3 == 0)
    return rounded(op.region_fp(p, ["building", "boundary"], 0.5))


@query("c17_hist_quantile", f"""WITH {PRED}, hi AS (SELECT lang, floor(prob * 1000) AS bin, count(*) AS n FROM pr GROUP BY 1, 2), cm AS (SELECT lang, bin, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY lang) AS total FROM hi)
SELECT lang, q, min(bin) / 1000 AS value FROM cm, (VALUES (0.1), (0.5), (0.9)) v(q) WHERE cum >= q * total GROUP BY 1, 2""".replace("SELECT lang, q,", "SELECT lang, CAST(q AS DOUBLE) AS q,"))
def _(t):
    return op.hist_quantile(predictions(t), "prob", [0.1, 0.5, 0.9], by=["lang"])


@query("c18_bce_dice", f"""WITH {PRED}, z AS (SELECT lang, target, prob * 6 - 3 AS z, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1.0 + doc_id % 3 END AS w FROM pr)
SELECT lang, round(sum((greatest(z, 0) - z * target + ln(1 + exp(-abs(z)))) * w) / sum(w), 6) AS bce, round(1 - (2 * sum(target / (1 + exp(-z))) + 1) / (sum(1 / (1 + exp(-z))) + sum(target) + 1), 6) AS dice FROM z WHERE w > 0 GROUP BY 1""")
def _(t):
    p = predictions(t).withColumn("logit", F.col("prob") * 6 - 3).withColumn("weight", F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(1.0 + F.col("doc_id") % 3))
    return rounded(op.bce_dice(p, "lang"))


@query("c19_guarded_select", f"WITH {HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY -iou, epoch) AS k, count(*) OVER (PARTITION BY model) AS passing FROM h WHERE recall >= 0.4 - 0.1) SELECT model, epoch, passing FROM o WHERE k = 1")
def _(t):
    return op.guarded_select(history(t), "model", 0.4, 0.1, [-F.col("iou")])


@query("c19_guard_stop", f"""WITH {HISTORY}, f AS (SELECT *, CASE WHEN recall < 0.5 THEN 1 ELSE 0 END AS fail, lag(CASE WHEN recall < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY epoch) AS before FROM h)
SELECT model, min(CASE WHEN fail = 1 AND before = 1 THEN epoch END) AS stop_epoch FROM f GROUP BY 1""")
def _(t):
    return op.guard_stop(history(t), "model", 0.52, 0.02, 2)


@query("c20_best_by", f"WITH {HISTORY} SELECT model, arg_max(epoch, iou) AS epoch, round(max(iou), 6) AS iou FROM h GROUP BY 1")
def _(t):
    return rounded(op.best_by(history(t), "model", "iou"))


@query("c21_early_stop", f"""WITH {HISTORY}, b AS (SELECT model, epoch, iou, max(iou) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR iou > before THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY epoch) AS run FROM b), s AS (SELECT *, row_number() OVER (PARTITION BY model, run ORDER BY epoch) - 1 AS since FROM r)
SELECT model, min(CASE WHEN since >= 2 THEN epoch END) AS stop_epoch FROM s GROUP BY 1""")
def _(t):
    return op.early_stop(history(t), "model", "iou", 2)


@query("c22_seed_summary", f"WITH {HISTORY} SELECT model, round(avg(iou), 6) AS iou_mean, round(stddev_samp(iou), 6) AS iou_std, round(avg(recall), 6) AS recall_mean, round(stddev_samp(recall), 6) AS recall_std, max(n) AS n_max FROM h GROUP BY 1")
def _(t):
    return rounded(op.seed_summary(history(t), ["model"], ["iou", "recall"], ["n"]))


@query("c23_per_class", f"WITH {HISTORY} SELECT model, epoch, 'iou' AS class, round(iou, 6) AS value FROM h UNION ALL SELECT model, epoch, 'recall', round(recall, 6) FROM h")
def _(t):
    return rounded(op.per_class(history(t), ["model", "epoch"], ["iou", "recall"]))


@query("c23_per_class_wide", f"WITH {HISTORY} SELECT model, round(avg(iou), 6) AS iou, round(avg(recall), 6) AS recall FROM h GROUP BY 1")
def _(t):
    return rounded(op.per_class_wide(op.per_class(history(t), ["model", "epoch"], ["iou", "recall"]), ["model"], ["iou", "recall"]))


@query("c24_model_delta", f"WITH {HISTORY}, a AS (SELECT * FROM h WHERE model LIKE '1%'), b AS (SELECT * FROM h WHERE model LIKE '2%') SELECT epoch, round(a.iou, 6) AS a, round(b.iou, 6) AS b, round(b.iou - a.iou, 6) AS absolute, round((b.iou - a.iou) / a.iou, 6) AS relative, round(300 - b.iou, 6) AS gap FROM a JOIN b USING (epoch)")
def _(t):
    h = history(t)
    return rounded(op.delta(h.where("model like '1%'"), h.where("model like '2%'"), ["epoch"], "iou", 300.0))


@query("c25_prob_delta", f"""WITH {CELLS}, d AS (SELECT value AS va, least(value * 1.1, 1.0) AS vb, x % 4 AS g FROM cells)
SELECT g, count(*) AS n, round(avg(vb - va), 6) AS mean, round(avg(abs(vb - va)), 6) AS mean_abs, round(quantile_cont(abs(vb - va), 0.1), 6) AS p10_abs, round(quantile_cont(abs(vb - va), 0.5), 6) AS p50_abs, round(quantile_cont(abs(vb - va), 0.9), 6) AS p90_abs, round(quantile_cont(abs(vb - va), 0.99), 6) AS p99_abs, round(avg(va), 6) AS mean_a, round(avg(vb), 6) AS mean_b FROM d GROUP BY 1""")
def _(t):
    a = cells(t).withColumn("g", F.col("x") % 4)
    return rounded(op.prob_delta(a, a.withColumn("value", F.least(F.col("value") * 1.1, F.lit(1.0))), ["g", "x", "y"], by=["g"]))


@query("c26_top_windows", f"""WITH {CELLS}, o AS (SELECT i * 8 AS w FROM range(0, 7) r(i)), a AS (SELECT 0 AS scene_id, ox.w AS wx, oy.w AS wy, avg(value) AS mean FROM cells, o ox, o oy WHERE x BETWEEN ox.w AND ox.w + 15 AND y BETWEEN oy.w AND oy.w + 15 AND ox.w + 15 <= (SELECT max(x) FROM cells) AND oy.w + 15 <= (SELECT max(y) FROM cells) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (ORDER BY round(mean, 12) DESC, wy, wx) AS rank FROM a) SELECT scene_id, rank, wx, wy, round(mean, 6) AS mean FROM r WHERE rank <= 3""")
def _(t):
    return rounded(op.top_windows(cells(t).withColumn("scene_id", F.lit(0)), 16, 8, 3))


@query("c27_prob_stats", f"WITH {CELLS} SELECT x % 4 AS g, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) FILTER (value > 0.5) AS above FROM cells GROUP BY 1")
def _(t):
    return rounded(op.prob_stats(cells(t).withColumn("g", F.col("x") % 4), 0.5, by=["g"]))


@query("c28_positive_ratio", f"WITH {CELLS} SELECT x % 4 AS g, round(avg(CASE WHEN value > 0.5 THEN 1 ELSE 0 END), 6) AS ratio FROM cells GROUP BY 1")
def _(t):
    return rounded(op.positive_ratio(cells(t).withColumn("g", F.col("x") % 4), 0.5, ["g"]))


@query("c29_disk_mean", f"""WITH {CELLS}, p AS (SELECT s_suppkey AS id, round_even(s_acctbal / 200, 0) AS px, s_nationkey * 2 AS py FROM supplier)
SELECT id, count(*) AS n, round(avg(value), 6) AS mean FROM p JOIN cells ON (x - px) * (x - px) + (y - py) * (y - py) <= 25 GROUP BY 1""")
def _(t):
    p = t.supplier.select(F.lit(0).alias("scene_id"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 200).alias("x"), (F.col("s_nationkey") * 2).alias("y"))
    return rounded(op.disk_mean(p, cells(t).withColumn("scene_id", F.lit(0)), 5).drop("scene_id"))
