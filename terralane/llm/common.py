"""Helpers shared by the training-data operators: scratch tables, row ids, skew-safe lookups and word splitting."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import free, shared_dir, stored  # noqa: F401

#: A word is a run without ASCII white space; bytes.split() cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: A group is hot when it holds more than one row in HOT_PARTS, so there are fewer than HOT_PARTS hot groups.
HOT_PARTS = 1000


def with_row_id(docs: DataFrame, name: str = "__row") -> DataFrame:
    """A number for each row, fixed only once the result is stored: another scan may number the rows differently."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def text_key(text: Column) -> Column:
    """128 bits of a text, which find it again in another scan, however its rows are split there."""
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker gives its freed memory back: Spark keeps it for later tasks and stages."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one where df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def lower_ascii(text):
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(facts: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of facts with one row per key, safe when one key holds a third of all facts.

    groups has one row per key with the number of its facts in `size`. The fewer than HOT_PARTS keys with more
    than total / HOT_PARTS facts are broadcast; a key that is joined by shuffle holds at most that share.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_PARTS > total))
    cold = groups.where(F.col(size) * HOT_PARTS <= total)
    return facts.join(hot, key).unionByName(facts.join(hot, key, "left_anti").join(cold, key))
