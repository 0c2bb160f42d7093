"""Sampling of cell tables at points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def bilinear(points: DataFrame, cells: DataFrame, by: Sequence[str] = ("scene_id",), value: str = "value") -> DataFrame:
    """(*by, id, value): weighted sum of the four cells around each point; missing cells add nothing."""
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corner = lambda i, j: F.struct((F.floor("x") + i).cast("long").alias("x"), (F.floor("y") + j).cast("long").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    four = points.select(*by, "id", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("c")).select(*by, "id", "c.x", "c.y", "c.w")
    return four.join(cells.select(*by, "x", "y", F.col(value).alias("__v")), [*by, "x", "y"]).groupBy(*by, "id").agg(F.sum(F.col("w") * F.col("__v")).alias("value"))
