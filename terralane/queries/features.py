"""Embedding and tile queries (image = label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import features as op
from .inputs import POINTS, PRED, points, predictions, rounded

LONG = "lo AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, 64)) AS dim FROM embeddings)"
IMG = "im AS (SELECT c_custkey AS scene_id, 40 + c_nationkey * 3 AS width, 30 + c_custkey % 50 AS height FROM customer)"
ORI = IMG + """, ox AS (SELECT DISTINCT scene_id, tx FROM (SELECT scene_id, unnest(list_append([i * 24 for i in range(0, CAST(floor(greatest(0, width - 32) / 24) AS BIGINT) + 1)], greatest(0, width - 32))) AS tx FROM im)),
oy AS (SELECT DISTINCT scene_id, ty FROM (SELECT scene_id, unnest(list_append([i * 24 for i in range(0, CAST(floor(greatest(0, height - 32) / 24) AS BIGINT) + 1)], greatest(0, height - 32))) AS ty FROM im)), tl AS (SELECT im.*, tx, ty FROM im JOIN ox USING (scene_id) JOIN oy USING (scene_id))"""
OBS = "ob AS (SELECT l_suppkey % 5 AS scene_id, l_partkey % 6 * 8 AS tx, l_suppkey % 4 * 8 AS ty, l_orderkey % 16 AS lx, l_linenumber * 2 AS ly, l_discount * 10 AS value FROM lineitem)"


def images(t):
    return t.customer.select(F.col("c_custkey").alias("scene_id"), (40 + F.col("c_nationkey") * 3).alias("width"), (30 + F.col("c_custkey") % 50).cast("int").alias("height"))


def tile_cells(t):
    return t.lineitem.select((F.col("l_suppkey") % 5).alias("scene_id"), (F.col("l_partkey") % 6 * 8).alias("tx"), (F.col("l_suppkey") % 4 * 8).alias("ty"), (F.col("l_orderkey") % 16).alias("lx"), (F.col("l_linenumber") * 2).cast("long").alias("ly"), (F.col("l_discount") * 10).alias("value"))


@query("d1_extract_features")
def _(t):
    import numpy as np

    def encoder(n, i):
        return np.stack([n % 7, i % 11, n * 0 + 1], 1).astype(np.float32)

    return op.extract_features(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n"), F.col("doc_id").cast("double").alias("i")), encoder, ["n", "i"]).select("doc_id", "embedding")


@query("d2_l2_normalize", f"WITH {LONG}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS n, sum(v) AS total FROM lo GROUP BY 1) SELECT vec_id, round(total / greatest(n, 1e-12), 5) AS total FROM s")
def _(t):
    return rounded(t.embeddings.select("vec_id", F.aggregate(op.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, v: a + v).alias("total")), 5)


@query("d3_shared_pca")
def _(t):
    return op.pca_transform(t.embeddings, op.pca_fit(t.embeddings, 3)).select("vec_id", F.transform("components", lambda v: F.round(v, 6)).alias("components"))


@query("d4_image_pca")
def _(t):
    return op.pca_transform(t.embeddings, op.pca_fit(t.embeddings, 3, by=["label"]), by=["label"]).select("vec_id", "label", F.transform("components", lambda v: F.round(v, 6)).alias("components"))


@query("d5_scale_minmax", f"WITH {POINTS} SELECT id, scene_id, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * 255, 5) AS scaled FROM pts WINDOW w AS (PARTITION BY scene_id)")
def _(t):
    return rounded(op.scale_minmax(points(t), "x", ["scene_id"]).select("id", "scene_id", "scaled"), 5)


@query("d6_scale_percentile", f"WITH {POINTS}, p AS (SELECT scene_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM pts GROUP BY 1) SELECT id, scene_id, round(greatest(0, least(1, (x - lo) / (hi - lo))), 6) AS scaled FROM pts JOIN p USING (scene_id)")
def _(t):
    return rounded(op.scale_percentile(points(t), "x", ["scene_id"]).select("id", "scene_id", "scaled"))


@query("d7_tile_grid", f"WITH {ORI} SELECT * FROM tl")
def _(t):
    return op.tile_grid(images(t), 32, 8)


@query("d8_fuse_mean", f"WITH {OBS} SELECT scene_id, tx + lx AS x, ty + ly AS y, round(avg(value), 6) AS value, count(*) AS covers FROM ob GROUP BY 1, 2, 3")
def _(t):
    return rounded(op.fuse_mean(tile_cells(t)))


@query("d9_fuse_weighted", f"WITH {OBS}, w AS (SELECT *, least(1, 0.05 + 0.95 * least(lx, 15 - lx) / 4) * least(1, 0.05 + 0.95 * least(ly, 15 - ly) / 4) AS w FROM ob) SELECT scene_id, tx + lx AS x, ty + ly AS y, round(sum(value * w) / greatest(sum(w), 1e-8), 6) AS value FROM w GROUP BY 1, 2, 3")
def _(t):
    return rounded(op.fuse_weighted(tile_cells(t), 16, 4))


@query("d10_coverage", f"WITH {OBS}, c AS (SELECT scene_id, tx + lx AS x, ty + ly AS y, count(*) AS n FROM ob GROUP BY 1, 2, 3) SELECT scene_id, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, 56 * 40 - count(*) AS uncovered FROM c GROUP BY 1")
def _(t):
    im = tile_cells(t).select("scene_id").distinct().withColumn("width", F.lit(56)).withColumn("height", F.lit(40))
    return rounded(op.coverage(tile_cells(t), im))


@query("d11_best_tile", f"""WITH {ORI}, p AS (SELECT o_orderkey AS id, o_custkey AS scene_id, o_totalprice % 40 AS x, o_orderkey % 30 + 0.5 AS y FROM orders), m AS (SELECT p.*, tx, ty, least(x - tx, tx + 32 - x, y - ty, ty + 32 - y) AS margin FROM p JOIN tl USING (scene_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, id ORDER BY margin DESC, ty, tx) AS k FROM m WHERE margin >= 0) SELECT scene_id, id, tx, ty, round(margin, 6) AS margin FROM r WHERE k = 1""")
def _(t):
    p = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scene_id"), (F.col("o_totalprice") % 40).alias("x"), (F.col("o_orderkey") % 30 + 0.5).alias("y"))
    return rounded(op.best_tile(p, op.tile_grid(images(t), 32, 8), 32))


@query("d12_ensemble_softmax", "WITH h AS (SELECT vec_id, (embedding[1]::DOUBLE + embedding[4]::DOUBLE) / 2 AS a, (embedding[2]::DOUBLE + embedding[5]::DOUBLE) / 2 AS b, (embedding[3]::DOUBLE + embedding[6]::DOUBLE) / 2 AS c FROM embeddings) SELECT vec_id, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS p FROM h")
def _(t):
    e = t.embeddings.select("vec_id", F.array(*(F.array(*(F.col("embedding")[3 * h + i].cast("double") for i in range(3))) for h in range(2))).alias("heads"))
    return rounded(e.select("vec_id", op.ensemble_softmax(e, "heads", 1).alias("p")))


@query("d13_linear_probe")
def _(t):
    from ..operators.labels import class_weights

    w = class_weights(t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    model = op.fit_probe(t.embeddings.where("vec_id % 5 <> 0"), w)
    from pyspark.ml.functions import array_to_vector

    test = t.embeddings.where("vec_id % 5 = 0").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    return model.transform(test).groupBy("label", F.col("prediction").cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("d14_two_stage_forest")
def _(t):
    rows = predictions(t).join(t.documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("target").cast("double").alias("real"), (F.col("doc_id") % 2).cast("double").alias("connect"), F.col("n_chars").cast("double").alias("a"), "prob")
    first, second = op.fit_two_stage(rows, ["a", "prob"])
    out = first.transform(rows).select("doc_id", F.col("prediction").cast("int").alias("real"))
    return out.join(second.transform(rows).select("doc_id", F.col("prediction").cast("int").alias("connect")), "doc_id")


@query("d15_feature_vector", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN n_chars ELSE 0 END AS a, 0.0 AS b, CAST(doc_id AS DOUBLE) AS c FROM documents")
def _(t):
    m = F.map_concat(F.when(F.col("n_chars") % 2 == 0, F.create_map(F.lit("size"), F.col("n_chars").cast("double"))).otherwise(F.create_map(F.lit("other"), F.lit(1.0))), F.create_map(F.lit("id"), F.col("doc_id").cast("double")))
    v = t.documents.select("doc_id", op.feature_vector(m, ["size", "gap", "id"]).alias("v"))
    return v.select("doc_id", F.col("v")[0].cast("long").alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"))


@query("d16_pool_path", f"WITH {LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY label, dim ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label, dim) AS n FROM lo) SELECT label, CAST(dim AS INT) AS dim, round(max(CASE WHEN k = 1 THEN v END), 5) AS first, round(max(CASE WHEN k = (n + 1) // 2 THEN v END), 5) AS middle, round(max(CASE WHEN k = n THEN v END), 5) AS last, round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS std, round(min(v), 5) AS min FROM k GROUP BY 1, 2")
def _(t):
    e = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(op.pool_path(e, ["label"], "vec_id"), 5)


@query("d17_path_features", """WITH s AS (SELECT user_id AS id, event_id AS k, value, event_id * 37 % 1000 AS x, value * 2 AS y FROM events), z AS (SELECT *, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS step FROM s WINDOW w AS (PARTITION BY id ORDER BY k)),
g AS (SELECT id, avg(value) AS mean, median(value) AS median, quantile_cont(value, 0.1) AS p10, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, coalesce(sum(step), 0) AS length, arg_max(x, k) - arg_min(x, k) AS dx, arg_max(y, k) - arg_min(y, k) AS dy FROM z GROUP BY 1)
SELECT id, round(mean, 5) AS mean, round(median, 5) AS median, round(p10, 5) AS p10, round(std, 5) AS std, round(min, 5) AS min, round(max, 5) AS max, round(length, 5) AS length, round(CASE WHEN length > 0 THEN sqrt(dx*dx+dy*dy) / length ELSE 0 END, 5) AS chord_ratio, round(degrees(atan2(dy, dx)), 5) AS direction FROM g""")
def _(t):
    s = t.events.select(F.col("user_id").alias("id"), F.col("event_id").alias("k"), "value", (F.col("event_id") * 37 % 1000).alias("x"), (F.col("value") * 2).alias("y"))
    return rounded(op.path_features(s, ["id"], "k"), 5)


@query("d18_norm_stats", f"WITH {LONG}, n AS (SELECT vec_id, label, sqrt(sum(v * v)) AS n FROM lo GROUP BY 1, 2) SELECT label, round(avg(n), 5) AS norm_mean, round(stddev_pop(n), 5) AS norm_std FROM n GROUP BY 1")
def _(t):
    return rounded(op.norm_stats(t.embeddings, ["label"]), 5)


@query("d19_effective_rank")
def _(t):
    return rounded(op.effective_rank(t.embeddings))
