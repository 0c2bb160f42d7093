"""Connected components: edges are contracted where they lie, then by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.scratch import free, stored


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the least node that each reaches by them."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        a, b = least[u], least[v]
        open_ = a != b
        if not open_.any():
            return nodes, nodes[least]
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]


#: Edges that a task holds before it contracts them.
HELD_EDGES = 1 << 20


def contracted(edges: DataFrame, by: list[str]) -> DataFrame:
    """Edges (*by, u, v) whose partitions have become stars: each task links its nodes to the least one that it reaches. A task holds one edge per node, and the next HELD_EDGES."""
    schema = edges.select(*by, "u", "v").schema

    def stars(table: pa.Table) -> pa.Table:
        graph = np.zeros(table.num_rows, np.int64)
        for c in by:
            code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            graph = np.unique(graph * (int(code.max()) + 1) + code, return_inverse=True)[1]
        # a node is numbered by its graph, then by its id, so the least number has the least id
        ids, at = np.unique(np.concatenate([table.column("u").to_numpy(), table.column("v").to_numpy()]), return_inverse=True)
        key = np.concatenate([graph, graph]) * len(ids) + at
        nodes, least = least_nodes(*np.split(key, 2))
        own = nodes != least
        row = np.empty(int(graph.max()) + 1, np.int64)
        row[graph] = np.arange(len(graph))
        names = table.select(by).take(pa.array(row[nodes[own] // len(ids)]))
        return pa.table([*names.columns, pa.array(ids[nodes[own] % len(ids)]), pa.array(ids[least[own] % len(ids)])], names=[*by, "u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += b.num_rows
            if rows >= HELD_EDGES:
                held, rows = [stars(pa.concat_tables(held))], 0
        if held and sum(t.num_rows for t in held):
            yield from stars(pa.concat_tables(held)).to_batches()

    return edges.mapInArrow(run, schema)


def are_stars(e: DataFrame, by: list[str]) -> bool:
    """Whether every node has one edge to a least node that has none."""
    ends = e.select(*by, F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(e.select(*by, F.col("v").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy(*by, "x").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n")).where("ups > 1 or (ups > 0 and n > ups)").isEmpty()


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", by: list[str] | None = None) -> DataFrame:
    """(*by, node, component) of every node that has an edge; component is its least node.

    Each round links all larger neighbours of a node to the least node around it, then all smaller ones, until
    every component is a star around its least node (a number of rounds about logarithmic in the longest path). Edges of nodes that are
    long are first contracted where they lie, before any shuffle, so what is shuffled follows the nodes of each partition and not the edges. A round is four shuffles of at most one row per edge; it is written to the
    shared folder, and the round before is deleted. Loops and repeated edges count for nothing. by: columns that keep graphs apart.
    """
    by = by or []
    e = edges.select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    if e.schema["u"].dataType == e.schema["v"].dataType == T.LongType():
        e = contracted(e, by)
    e = stored(e.distinct(), "edges")
    while not are_stars(e, by):
        both = e.unionByName(e.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*by, "u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*by, "u"]).where("v <> m").select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, stored(small.unionByName(least.select(*by, "u", F.col("m").alias("v"))).distinct(), "edges")
        free(before)
    return e.select(*by, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(*by, F.col("v").alias("node"), F.col("v").alias("component")).distinct())
