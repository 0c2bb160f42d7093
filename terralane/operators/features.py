"""Embedding tables and tiles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

FLOOR = 1e-12


def extract_features(work: DataFrame, encoder: Callable, columns: Sequence[str], size: int = 64) -> DataFrame:
    """Add embedding: a batch encoder (arrays of the columns -> array [n, d]) over the rows of a work list."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, FloatType

    return work.withColumn("embedding", predict_batch_udf(lambda: encoder, return_type=ArrayType(FloatType()), batch_size=size)(*columns))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector over its length, a length of 1e-12 at least."""
    n = F.greatest(norm(v), F.lit(FLOOR))
    return F.transform(v, lambda x: x.cast("double") / n)


def moments(df: DataFrame, column: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, mean, cov): population covariance of vectors, from sums of outer products gathered in each task.

    A task sends one sum per group, whatever the number of its rows.
    """
    import pandas as pd

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    schema = (kinds + ", " if by else "") + "n long, s array<double>, ss array<double>"

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(list(by), dropna=False) if by else [((), pdf)]:
                x = np.stack(rows[column].to_numpy()).astype(np.float64)
                got = sums.setdefault(tuple(key), [0, 0.0, 0.0])
                got[0], got[1], got[2] = got[0] + len(x), got[1] + x.sum(0), got[2] + x.T @ x
        yield pd.DataFrame([(*k, n, s.tolist(), ss.ravel().tolist()) for k, (n, s, ss) in sums.items()], columns=[*by, "n", "s", "ss"])

    parts = df.select(*by, column).mapInPandas(partial, schema)
    add = lambda c: F.aggregate(F.collect_list(c), F.transform(F.first(c), lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
    total = parts.groupBy(*by).agg(F.sum("n").alias("n"), add("s").alias("s"), add("ss").alias("ss"))
    mean = F.transform("s", lambda x: x / F.col("n"))
    d = F.size("mean")
    cov = F.transform("ss", lambda x, i: x / F.col("n") - F.get("mean", F.floor(i / d).cast("int")) * F.get("mean", (i % d).cast("int")))
    return total.withColumn("mean", mean).withColumn("cov", cov).select(*by, "n", "mean", "cov")


def pca_fit(df: DataFrame, k: int = 3, column: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """(*by, mean, components): k leading directions, each with its largest loading positive."""
    import pandas as pd

    m = moments(df, column, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in m.select(*by).schema)
    schema = (kinds + ", " if by else "") + "mean array<double>, components array<array<double>>"

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean = np.asarray(r.mean)
                _, vec = np.linalg.eigh(np.asarray(r.cov).reshape(len(mean), -1))
                top = vec[:, ::-1][:, :k].T
                top = top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]
                rows.append((*(getattr(r, b) for b in by), mean.tolist(), top.tolist()))
            yield pd.DataFrame(rows, columns=[*by, "mean", "components"])

    return m.mapInPandas(solve, schema)


def pca_transform(df: DataFrame, model: DataFrame, column: str = "embedding", by: Sequence[str] = ()) -> DataFrame:
    """Add components array<double>: centred projections. A shared model is one row; a model per group joins by it."""
    model = model.select(*by, F.col("mean").alias("__mean"), F.col("components").alias("__axes"))
    rows = df.join(model, list(by)) if by else df.crossJoin(F.broadcast(model))  # a single row
    centred = F.zip_with(column, "__mean", lambda a, b: a.cast("double") - b)
    dot = F.transform("__axes", lambda axis: F.aggregate(F.zip_with(axis, "__centred", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v))
    return rows.withColumn("__centred", centred).withColumn("components", dot).drop("__mean", "__axes", "__centred")


def scale_minmax(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Add scaled: 0 to 255 between the least and the greatest value of a group; a constant group is 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.when(high > low, (F.col(value) - low) / (high - low) * 255).otherwise(0.0))


def scale_percentile(df: DataFrame, value: str, by: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Add scaled: 0 to 1 between two percentiles of a group, clipped."""
    p = df.groupBy(*by).agg(F.percentile(value, F.lit(low)).alias("__lo"), F.percentile(value, F.lit(high)).alias("__hi"))
    s = F.when(F.col("__hi") > F.col("__lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))))).otherwise(0.0)
    return df.join(p, list(by)).withColumn("scaled", s).drop("__lo", "__hi")


def origins(length: Column, tile: int, stride: int) -> Column:
    """Tile starts at the stride, the last flush with the edge; one start for a short side."""
    last = F.greatest(F.lit(0), length - tile).cast("int")
    return F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(last / stride).cast("int")), lambda i: i * stride), F.array(last)))


def tile_grid(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(…, tx, ty): the tiles that cover each image (width, height)."""
    stride = tile - overlap
    return images.withColumn("tx", F.explode(origins(F.col("width"), tile, stride))).withColumn("ty", F.explode(origins(F.col("height"), tile, stride)))


def fuse_mean(tile_cells: DataFrame, by: Sequence[str] = ("scene_id",), value: str = "value") -> DataFrame:
    """(*by, x, y, value, covers): mean of the tiles' values at each global cell; tiles have (tx, ty) and local (lx, ly)."""
    return tile_cells.groupBy(*by, (F.col("tx") + F.col("lx")).alias("x"), (F.col("ty") + F.col("ly")).alias("y")).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("covers"))


def ramp_weight(lx: Column, ly: Column, tile: int, edge: int) -> Column:
    """1 inside a tile, falling to 0.05 at its border over `edge` cells."""
    side = lambda c: F.least(F.lit(1.0), F.lit(0.05) + 0.95 * F.least(c, tile - 1 - c) / edge)
    return side(lx) * side(ly)


def fuse_weighted(tile_cells: DataFrame, tile: int, edge: int, by: Sequence[str] = ("scene_id",), value: str = "value") -> DataFrame:
    w = ramp_weight(F.col("lx"), F.col("ly"), tile, edge)
    rows = tile_cells.withColumn("__w", w)
    return rows.groupBy(*by, (F.col("tx") + F.col("lx")).alias("x"), (F.col("ty") + F.col("ly")).alias("y")).agg((F.sum(F.col(value) * F.col("__w")) / F.greatest(F.sum("__w"), F.lit(1e-8))).alias("value"))


def coverage(tile_cells: DataFrame, images: DataFrame, by: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Per image: least, most and mean number of tiles over a covered cell, and the number of uncovered cells."""
    c = fuse_mean(tile_cells.withColumn("__one", F.lit(1)), by, "__one")
    c = c.groupBy(*by).agg(F.min("covers").alias("least"), F.max("covers").alias("most"), F.avg("covers").alias("mean"), F.count(F.lit(1)).alias("covered"))
    return images.join(c, list(by), "left").withColumn("uncovered", F.col("width") * F.col("height") - F.coalesce("covered", F.lit(0))).drop("width", "height", "covered")


def best_tile(points: DataFrame, tiles: DataFrame, tile: int, by: str = "scene_id") -> DataFrame:
    """(by, id, tx, ty, margin): the covering tile whose border is farthest from each point; equal ones by place.

    Points and tiles meet in square cells of a tile's size, four for a tile.
    """
    from ..functions.spatial import box_cells, cell

    t = tiles.select(by, "tx", "ty").withColumn("x1", F.col("tx") + tile - 1).withColumn("y1", F.col("ty") + tile - 1).withColumn("c", box_cells("tx", "ty", "x1", "y1", tile))
    p = points.select(by, "id", "x", "y", F.struct(cell("x", tile).alias("x"), cell("y", tile).alias("y")).alias("c"))
    m = F.least(F.col("x") - F.col("tx"), F.col("tx") + tile - F.col("x"), F.col("y") - F.col("ty"), F.col("ty") + tile - F.col("y"))
    # tiles are many more than the images that Spark estimates them by: never broadcast on that estimate
    rows = p.join(t.hint("merge"), [by, "c"]).withColumn("margin", m).where("margin >= 0")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(by, "id").orderBy(F.desc("margin"), "ty", "tx"))).where("k = 1").select(by, "id", "tx", "ty", "margin")


def ensemble_softmax(df: DataFrame, heads: str, cls: int) -> Column:
    """Softmax share of a class of the mean of several heads' logits (array<array<double>>)."""
    n = F.size(heads)
    mean = F.transform(F.col(heads)[0], lambda _, i: F.aggregate(heads, F.lit(0.0), lambda a, h: a + h[i]) / n)
    e = F.transform(mean, lambda v: F.exp(v - F.array_max(mean)))
    return e[cls] / F.aggregate(e, F.lit(0.0), lambda a, v: a + v)


def fit_probe(train: DataFrame, weights: DataFrame, label: str = "label", column: str = "embedding", max_iter: int = 50):
    """A class-weighted multinomial linear classifier on embeddings."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = train.join(weights.select(label, "weight"), label).select(F.col(label).cast("double").alias("label"), "weight", array_to_vector(column).alias("features"))
    return LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter).fit(rows)


def fit_two_stage(rows: DataFrame, features: Sequence[str], seed: int = 7, trees: int = 100):
    """Two forests with balanced classes: real or false on all labelled rows, connect or not on the real ones."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    def fit(df: DataFrame, label: str):
        n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
        df = df.join(F.broadcast(n), label).withColumn("__w", 1.0 / F.col("__n"))  # one row a class
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), RandomForestClassifier(labelCol=label, weightCol="__w", numTrees=trees, seed=seed)]).fit(df)

    return fit(rows.where("real is not null"), "real"), fit(rows.where("real = 1 and connect is not null"), "connect")


def feature_vector(features: Column, names: Sequence[str]) -> Column:
    """The named entries of a map in order, 0 where missing."""
    return F.array(*(F.coalesce(features[n], F.lit(0.0)) for n in names))


def pool_path(samples: DataFrame, by: Sequence[str], order: str, column: str = "embedding") -> DataFrame:
    """(*by, dim, first, middle, last, mean, std, min): samples along a path, each dimension on its own."""
    w = Window.partitionBy(*by)
    s = samples.withColumn("__k", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(w))
    s = s.select(*by, "__k", "__n", F.posexplode(column).alias("dim", "v"))
    at = lambda k: F.max(F.when(F.col("__k") == k, F.col("v")))
    return s.groupBy(*by, "dim").agg(at(F.lit(1)).alias("first"), at(F.floor((F.col("__n") + 1) / 2)).alias("middle"), at(F.col("__n")).alias("last"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"))


def path_features(samples: DataFrame, by: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Per path: statistics of its probabilities, length, end-to-end distance over length, and direction in degrees."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    s = samples.withColumn("__step", step)
    end = lambda f, c: f(c, order)
    g = s.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.percentile(value, F.lit(0.1)).alias("p10"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length"),
        *(end(f, c).alias(f"{n}{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in ("x", "y")),
    )
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    chord = F.sqrt(dx * dx + dy * dy)
    return g.withColumn("chord_ratio", F.when(F.col("length") > 0, chord / F.col("length")).otherwise(0.0)).withColumn("direction", F.degrees(F.atan2(dy, dx))).drop("ax", "ay", "bx", "by")


def norm_stats(df: DataFrame, by: Sequence[str], column: str = "embedding") -> DataFrame:
    """Mean and population deviation of vector lengths."""
    return df.groupBy(*by).agg(F.avg(norm(F.col(column))).alias("norm_mean"), F.stddev_pop(norm(F.col(column))).alias("norm_std"))


def effective_rank(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(mean_variance, effective_rank): mean variance of the dimensions; exp of the entropy of the singular values' shares."""
    import pandas as pd

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                c = np.asarray(r.cov).reshape(len(r.mean), -1)
                s = np.sqrt(np.maximum(np.linalg.eigvalsh(c), 0))
                p = s / max(s.sum(), FLOOR)
                p = p[p > 0]
                out.append((float(np.trace(c) / len(c)), float(np.exp(-(p * np.log(p)).sum()))))
            yield pd.DataFrame(out, columns=["mean_variance", "effective_rank"])

    return moments(df, column).mapInPandas(solve, "mean_variance double, effective_rank double")
