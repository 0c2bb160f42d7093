"""Exact quantiles of large groups by counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.scratch import stored


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """(*by, the names of shares): what F.percentile gives for each group, nulls left out.

    F.percentile holds all distinct values of a group in one task. Here a first pass counts values in narrow buckets in their order, which tells the
    buckets that hold the wanted places; a second pass counts the values of these alone.
    """
    v = F.col("__v")
    bucket = F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * 8192))
    own = rows.select(F.struct(*by).alias("__g"), F.col(value).cast("double").alias("__v")).where("__v is not null").withColumn("__b", bucket)
    counts = stored(own.groupBy("__g", "__b").agg(F.count(F.lit(1)).alias("n")), "buckets")
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("__g").orderBy("__b"))).withColumn("total", F.sum("n").over(Window.partitionBy("__g")))
    place = lambda share: (F.col("total") - 1) * F.lit(float(share))
    side = lambda name, share, f: F.struct(F.lit(name).alias("name"), F.lit(f.__name__).alias("side"), place(share).alias("place"), f(place(share)).alias("at"))
    wanted = counts.withColumn("q", F.explode(F.array(*(side(name, share, f) for name, share in shares.items() for f in (F.floor, F.ceil)))))
    wanted = stored(wanted.where("q.at >= upto - n and q.at < upto").select("__g", "__b", "q.*", (F.col("upto") - F.col("n")).alias("before")), "places")
    # some rows a group
    held = own.join(F.broadcast(wanted.select("__g", "__b").distinct()), ["__g", "__b"], "left_semi").groupBy("__g", "__b", "__v").agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("upto", F.sum("n").over(Window.partitionBy("__g", "__b").orderBy("__v")))
    found = held.join(F.broadcast(wanted), ["__g", "__b"]).where("at - before >= upto - n and at - before < upto")
    pick = lambda name, s: F.max(F.when((F.col("name") == name) & (F.col("side") == s), F.struct("__v", "place", "at")))
    found = found.groupBy("__g").agg(*(pick(name, s).alias(f"{name}_{s}") for name in shares for s in ("floor", "ceil")))

    def between(name: str):
        lo, hi = F.col(f"{name}_floor"), F.col(f"{name}_ceil")
        mixed = (hi["at"] - lo["place"]) * lo["__v"] + (lo["place"] - lo["at"]) * hi["__v"]
        return F.when(lo["__v"] == hi["__v"], lo["__v"]).otherwise(mixed).alias(name)

    return found.select(*(F.col("__g")[c].alias(c) for c in by), *(between(name) for name in shares))
