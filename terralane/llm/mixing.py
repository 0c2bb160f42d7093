"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import lookup, stored

#: So many sources' rates at most are sent to every task, under 10 MB; rates of more sources are joined.
SENT_SOURCES = 10_000

#: A larger mean is the sum of that many equal means below it, each with a draw of its own.
MEAN_STEP = 16.0


def uniform(*key: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of a seeded key."""
    text = F.concat_ws(":", *(k if isinstance(k, Column) else F.lit(k) for k in key))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def poisson_limits(mean: Column) -> Column:
    """P(N <= 0), P(N <= 1), ... for a mean of at most MEAN_STEP, far enough that the rest is below 2 ** -53."""
    most = math.ceil(MEAN_STEP + 12 * math.sqrt(MEAN_STEP) + 30)
    first = F.exp(-mean)
    step = lambda acc, i: F.struct((acc["p"] * mean / i).alias("p"), F.concat(acc["limits"], F.array(F.element_at(acc["limits"], -1) + acc["p"] * mean / i)).alias("limits"))
    start = F.struct(first.alias("p"), F.array(first).alias("limits"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc["limits"])


def rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, source: str = "source") -> DataFrame:
    """One row per source: n rows, mean number of copies of each of its documents, the parts and their limits.

    weights has (source, weight), of any positive sum; a source without a weight gets none. Without a table all sources
    weigh the same. total is the expected number of rows of the result; by default that of the documents.
    """
    name = F.coalesce(F.col(source), F.lit("")).alias("__source")
    counts = docs.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        counts = counts.withColumn("__w", F.lit(1.0))
    else:
        counts = counts.join(weights.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("__source")).agg(F.sum("weight").alias("__w")), "__source")
    sums = counts.agg(F.sum("__w").alias("__all"), F.sum("__n").alias("__rows"))
    if weights is not None:
        sums = sums.drop("__rows").crossJoin(docs.agg(F.count(F.lit(1)).alias("__rows")))  # one row with one row
    counts = counts.where("__w > 0").crossJoin(F.broadcast(sums))  # a single row of sums
    mean = F.col("__w") / F.col("__all") * (F.lit(total) if total is not None else F.col("__rows")) / F.col("__n")
    counts = counts.withColumn("__mean", mean).withColumn("__parts", F.ceil(F.col("__mean") / MEAN_STEP).cast("int"))
    return counts.select("__source", "__n", "__mean", "__parts", poisson_limits(F.col("__mean") / F.col("__parts")).alias("__limits"))


def mix(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 17, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Repeat each document a Poisson number of times, with the mean of its source, and shuffle all copies.

    The number is the inverse of the Poisson distribution at a number hashed from the seed, the document's key and its text,
    so it neither depends on the partitions nor changes when a task runs again, and rows that repeat a key (or have none) draw
    each for itself unless they repeat the text too. Result: all columns of docs, copy (from 1; replaced if docs has it)
    and position (in [0, 1)): rows are dealt to partitions at random and sorted by position within them, so that sorting by
    position gives one global shuffle of all rows. A null source is a source named by an empty text; a null key is a key,
    a null text an empty one. docs should read its rows alike each time, as files and stored tables do. No documents, or no weights for their sources, give no rows.
    """
    own = [i for i, c in enumerate(docs.columns) if c.lower() not in ("copy", "position")]
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: F.col(names[docs.columns.index(c)]) for c in (source, key, text)}
    rows = rows.select(*(names[i] for i in own), F.coalesce(at[source], F.lit("")).alias("__source"), F.concat_ws(":", F.coalesce(at[key].cast("string"), F.lit("null")), F.md5(F.coalesce(at[text], F.lit("")))).alias("__name"))
    # numbered where the documents are read: behind a shuffle, a task that runs again would number them in another order
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    known = stored(rates(rows, weights, total, "__source"), "rates")
    if known.count() <= SENT_SOURCES:
        rows = rows.join(F.broadcast(known), "__source")
    else:
        rows = lookup(rows, known, "__source", "__n", docs.count())
    draw = lambda j: F.size(F.filter("__limits", lambda p: p <= uniform(str(seed), F.col("__name"), j.cast("string"))))
    # the limits are ascending, so the copies are those that lie up to the draw
    n = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, j: acc + draw(j))
    rows = rows.withColumn("__copies", n).where("__copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    rows = rows.withColumn("position", uniform(f"{seed}-place", F.col("__name"), F.col("copy").cast("string")))
    # copies of one row stand at one place each; rows that repeat key and text are dealt apart by a number of their own
    rows = rows.repartition(F.col("position"), F.col("__row")).sortWithinPartitions("position")
    return rows.select(*(names[i] for i in own), "copy", "position").toDF(*(docs.columns[i] for i in own), "copy", "position")


ORACLE_SQL = """
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
t AS (SELECT s, n, 1.0::DOUBLE / (SELECT sum(1.0::DOUBLE) FROM n) * (SELECT sum(n) FROM n) / n AS mean FROM n),
m AS (SELECT s, mean, ceil(mean / 16)::INT AS parts, mean / ceil(mean / 16) AS part_mean FROM t),
d AS (SELECT doc_id, text, lang, source, n_chars, s, unnest(range(1, parts + 1)) AS j FROM documents JOIN m ON s = coalesce(source, '')),
u AS (SELECT *, (('0x' || substr(md5('17:' || doc_id || ':' || md5(coalesce(text, '')) || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
p AS (SELECT s, part_mean, i, exp(-part_mean + i * ln(part_mean) - lgamma(i + 1)) AS p FROM m, range(0, 95) r(i)),
c AS (SELECT s, i, sum(p) OVER (PARTITION BY s ORDER BY i) AS c FROM p),
l AS (SELECT s, list(c ORDER BY i) AS limits FROM c GROUP BY s),
k AS (SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(limits, lambda x: x <= u))) AS k FROM u JOIN l USING (s) GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k::INT + 1))::INT AS copy FROM k WHERE k > 0)
SELECT doc_id, text, lang, source, n_chars, copy, (('0x' || substr(md5('17-place:' || doc_id || ':' || md5(coalesce(text, '')) || ':' || copy), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS position FROM e
"""
