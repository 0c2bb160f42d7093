"""Exact dedup by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import lookup, lower_ascii, stored, with_row_id

#: Runs that one node of the merge tree takes from the level below.
FAN_IN = 16


def merge_runs(runs: DataFrame, leaves: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge (node, digest, n_bytes, best, group_size) runs up the tree until one node is left.

    In each round the partitions whose node numbers agree but for the last base-`fan_in` digit exchange their runs.
    The merge keys are digest and byte length together, so an entry is only merged with one verified on both, and
    it keeps the best identifier and the count. A level is itself spread over all partitions by (node, digest), and
    a digest leaves a task once however many rows hold it, so neither a level nor a hot digest meets in one task.
    """
    while True:
        runs = runs.groupBy("node", "digest", "n_bytes").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))
        if leaves <= 1:
            return runs.drop("node")
        leaves = -(-leaves // fan_in)
        runs = runs.withColumn("node", (F.col("node") / fan_in).cast("int"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Mark equal texts; texts are equal when identical after lower-casing A-Z.

    Result: doc_id, keep_id, group_size, kept, text_sha256, one row per input row. The row with the largest doc_id of
    a group stays. A null text counts as empty, a null doc_id is smaller than any other, and of rows that repeat
    text and doc_id the last one read stays. No rows give no rows. Only doc_id and text are read.
    """
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    base = stored(
        with_row_id(docs.select("doc_id", "text")).select(
            "doc_id", "__row", F.spark_partition_id().alias("node"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
        ),
        "digests",
    )
    leaves = (base.agg(F.max("node")).first()[0] or 0) + 1
    runs = base.select("node", "digest", "n_bytes", F.struct("doc_id", "__row").alias("best"), F.lit(1).cast("long").alias("group_size"))
    groups = merge_runs(runs, leaves).select("digest", "best", "group_size")
    return lookup(base.select("doc_id", "__row", "digest"), groups, "digest", "group_size", base.count()).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.__row") == F.col("__row")).alias("kept"), F.col("digest").alias("text_sha256")
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
