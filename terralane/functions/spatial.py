"""Grid joins: geometry is dealt to square cells and joined by cell, then tested exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.scratch import FEW_ROWS, few, stored


def cell(v: Column | str, side: float) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.floor(v / side).cast("long")


def box_cells(x0: str, y0: str, x1: str, y1: str, side: float, margin: float = 0.0) -> Column:
    """One row per cell that the box, widened by the margin, touches: struct<x, y>."""
    xs = F.sequence(cell(F.col(x0) - margin, side), cell(F.col(x1) + margin, side))
    ys = F.sequence(cell(F.col(y0) - margin, side), cell(F.col(y1) + margin, side))
    return F.explode(F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y"))))))


def first_cell(low: dict[str, tuple[str, str]], side: float, margin: float = 0.0) -> Column:
    """The first cell that two boxes share when box_cells dealt both: struct<x, y>. A pair that is kept there only meets once.

    low: the lower bounds of both boxes on either axis.
    """
    at = lambda axis: F.greatest(*(cell(F.col(c) - margin, side) for c in low[axis]))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def near_points(a: DataFrame, b: DataFrame, radius: float, by: str = "scene_id", strict: bool = False, places: bool = False) -> DataFrame:
    """(by, id_a, id_b, distance, with places also xa, ya, xb, yb) of points (by, id, x, y) at most (strict: less than) radius apart.

    b's points are in one cell each and a's points look into the nine cells around them, so each pair meets once.
    """
    side = float(radius)
    around = F.explode(F.array(*(F.struct((cell("x", side) + i).alias("cx"), (cell("y", side) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = a.select(by, F.col("id").alias("id_a"), F.col("x").alias("xa"), F.col("y").alias("ya"), around.alias("c")).select("*", "c.cx", "c.cy").drop("c")
    right = b.select(by, F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), cell("x", side).alias("cx"), cell("y", side).alias("cy"))
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    d = F.sqrt(dx * dx + dy * dy)
    pairs = left.join(right, [by, "cx", "cy"]).withColumn("distance", d)
    return pairs.where(F.col("distance") < radius if strict else F.col("distance") <= radius).select(by, "id_a", "id_b", "distance", *(["xa", "ya", "xb", "yb"] if places else []))


def near_segments(points: DataFrame, segments: DataFrame, radius: float, by: str = "scene_id") -> DataFrame:
    """(by, id, segment columns, distance, t) of points within radius of segments (by, segment_id, x0, y0, x1, y1).

    t is the place of the closest point along the segment, 0 to 1.
    """
    side = float(radius)
    s = segments.withColumn("lx", F.least("x0", "x1")).withColumn("hx", F.greatest("x0", "x1")).withColumn("ly", F.least("y0", "y1")).withColumn("hy", F.greatest("y0", "y1"))
    s = s.withColumn("c", box_cells("lx", "ly", "hx", "hy", side, radius)).select("*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")).drop("c", "lx", "hx", "ly", "hy")
    # few points go to the segments, whose copies then stay where they are made
    p = few(points.withColumn("cx", cell("x", side)).withColumn("cy", cell("y", side)))
    from .geom import segment_distance, segment_place

    joined = p.join(s, [by, "cx", "cy"]).drop("cx", "cy")
    joined = joined.withColumn("t", segment_place("x", "y", "x0", "y0", "x1", "y1"))
    return joined.withColumn("distance", segment_distance("x", "y", "x0", "y0", "x1", "y1")).where(F.col("distance") <= radius)


def nearest_in_block(px: np.ndarray, py: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, radius: float) -> np.ndarray:
    """Distance of each point to its nearest segment, inf where none lies within the radius."""
    return nearest_of_block(px, py, x0, y0, x1, y1, radius)[0]


def nearest_of_block(px: np.ndarray, py: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, radius: float, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each point to its nearest segment, inf where none lies within the radius, and that segment's place, -1 for none.

    Of segments equally far, to `digits` decimals where these are given (the distance is rounded to them, then), it is the first one.

    Segments are dealt to the cells of a fine grid and points look into the nine cells around them, which hold all segments up to 0.8 sides away. What finds
    none so near looks again in a grid of four times the side. The first side weighs cells per segment against segments per cell.
    """
    best, which = np.full(len(px), np.inf), np.full(len(px), -1)
    left, right, low, high = px.min() - radius, px.max() + radius, py.min() - radius, py.max() + radius
    dx, dy = x1 - x0, y1 - y0
    start, stop = np.zeros(len(x0)), np.ones(len(x0))
    # only the part within the radius of the points' box is dealt
    for a, d, lo, hi in ((x0, dx, left, right), (y0, dy, low, high)):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sort([(lo - a) / d, (hi - a) / d], axis=0)
        outside = (d == 0) & ((a < lo) | (a > hi))
        start = np.where(d == 0, np.where(outside, 2.0, start), np.maximum(start, t[0]))
        stop = np.where(d == 0, stop, np.minimum(stop, t[1]))
    inside = start <= stop
    place = np.flatnonzero(inside)
    x0, y0, x1, y1, dx, dy, start, stop = (v[inside] for v in (x0, y0, x1, y1, dx, dy, start, stop))
    if not len(x0):
        return best, which
    dealt = np.hypot(dx, dy) * (stop - start)
    l2 = dx * dx + dy * dy
    area = (right - left) * (high - low)
    side = np.clip(np.sqrt(area / (2 * len(px) + 1)), dealt.sum() / 2e6, 1.25 * radius)
    todo = np.arange(len(px))
    while len(todo):
        n = np.ceil(dealt / (0.4 * side)).astype(np.int64) + 1
        seg = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        f = start[seg] + (stop - start)[seg] * k / np.maximum(n - 1, 1)[seg]
        width = int((right - left) / side) + 4
        number = lambda x, y: (np.floor((y - low) / side).astype(np.int64) + 1) * width + np.floor((x - left) / side).astype(np.int64) + 1  # noqa: E731, B023
        cell = number(x0[seg] + f * dx[seg], y0[seg] + f * dy[seg])
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (cell[1:] != cell[:-1])
        cell, seg = cell[new], seg[new]
        order = np.argsort(cell, kind="stable")
        cell, seg = cell[order], seg[order]
        here = number(px[todo], py[todo])
        for row in (-width, 0, width):
            lo, hi = np.searchsorted(cell, here + row - 1), np.searchsorted(cell, here + row + 1, "right")
            ends = np.cumsum(hi - lo)
            i = 0
            while i < len(todo):
                # about a million distances at a time
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000, "right")))
                m = (hi - lo)[i:j]
                own = np.flatnonzero(m)
                if len(own):
                    first = np.cumsum(m) - m
                    s = seg[np.repeat(lo[i:j] - first, m) + np.arange(m.sum())]
                    p = np.repeat(todo[i:j], m)
                    qx, qy = px[p], py[p]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        t = np.where(l2[s] > 0, np.clip(((qx - x0[s]) * dx[s] + (qy - y0[s]) * dy[s]) / l2[s], 0.0, 1.0), 0.0)
                    ex, ey = qx - (x0[s] + t * dx[s]), qy - (y0[s] + t * dy[s])
                    d = np.sqrt(ex * ex + ey * ey)
                    d = np.where(d <= radius, d if digits is None else np.floor(d * 10.0**digits + 0.5) / 10.0**digits, np.inf)
                    least = np.minimum.reduceat(d, first[own])
                    at_least = np.minimum.reduceat(np.where(d == np.repeat(least, m[own]), s, len(x0)), first[own])
                    at = todo[i:j][own]
                    new = (least < best[at]) | ((least == best[at]) & np.isfinite(least) & (place[at_least] < which[at]))
                    best[at[new]], which[at[new]] = least[new], place[at_least[new]]
                i = j
        if side >= 1.25 * radius:
            break
        todo = todo[best[todo] > 0.8 * side - 1e-6]
        side = min(4 * side, 1.25 * radius)
    return best, which


#: Segments that a task looks at together.
HELD_SEGMENTS = 1 << 20


def nearest_segment(points: DataFrame, segments: DataFrame, radius: float, by: str, own: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Points (by, *own, x, y; own tells them apart) within the radius of a segment (by, *order, x0, y0, x1, y1, ...), with the nearest one's columns, distance and t; of segments equally far to 9 decimals the first by `order`.

    Up to FEW_ROWS points are sent to the tasks that hold the segments, which report one segment a point of the HELD_SEGMENTS that they look at together: neither
    segments nor pairs are shuffled. More points meet the segments by cells.
    """
    from .geom import segment_distance, segment_place

    points = points.select(by, *own, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if points.count() > FEW_ROWS:
        rank = F.row_number().over(Window.partitionBy(by, *own).orderBy(F.round("distance", 9), *order))
        return near_segments(points, segments, radius, by).withColumn("rank", rank).where("rank = 1").drop("rank")
    table = points.toArrow().combine_chunks()
    ends, rest = ("x0", "y0", "x1", "y1"), [c for c in segments.columns if c not in (by, "x0", "y0", "x1", "y1")]
    segments = segments.select(by, *(F.col(c).cast("double").alias(c) for c in ends), *rest)
    number = lambda t, c: t.column(c).to_numpy().astype(float)
    fit = np.isfinite(number(table, "x")) & np.isfinite(number(table, "y"))
    table = table.filter(pa.array(fit))
    scenes: dict = {}
    codes = table.column(by).combine_chunks().dictionary_encode()
    at = codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        scenes[name] = table.take(pa.array(np.flatnonzero(at == k)))
    sent = points.sparkSession.sparkContext.broadcast(scenes)
    schema = StructType([*points.schema.fields, *(f for f in segments.schema.fields if f.name != by), StructField("distance", DoubleType())])

    def look(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = t.column(by).combine_chunks().dictionary_encode()
        at = names.indices.to_numpy(zero_copy_only=False)
        for k, name in enumerate(names.dictionary.to_pylist()):
            p = sent.value.get(name)
            if p is None or not len(p):
                continue
            s = t.take(pa.array(np.flatnonzero(at == k)))
            s = s.take(pc.sort_indices(s, sort_keys=[(c, "ascending") for c in order]))
            d, which = nearest_of_block(number(p, "x"), number(p, "y"), *(number(s, c) for c in ends), radius, 9)
            hit = np.flatnonzero(which >= 0)
            s = s.take(pa.array(which[hit])).drop_columns([by])
            yield from pa.table([*p.take(pa.array(hit)).columns, *s.columns, pa.array(d[hit])], names=schema.names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= HELD_SEGMENTS:
                yield from look(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from look(pa.Table.from_batches(held))

    rows = segments.where(" and ".join(f"{c} is not null" for c in (by, *ends))).mapInArrow(run, schema)
    first = F.min_by(F.struct(*(c for c in rows.columns if c not in (by, *own))), F.struct("distance", *order)).alias("s")
    rows = rows.groupBy(by, *own).agg(first).select(by, *own, "s.*")
    return rows.withColumn("t", segment_place("x", "y", *ends)).withColumn("distance", segment_distance("x", "y", *ends))


def _finder(names: Sequence[str], margin: float):
    def find(p: pa.Table, q: pa.Table) -> pa.Table:
        p = p.select(names)
        x, y = (p[c].to_numpy().astype(float) for c in ("x", "y"))
        d, ok = np.full(len(p), np.inf), np.isfinite(x) & np.isfinite(y)
        if ok.any() and len(q):
            d[ok] = nearest_in_block(x[ok], y[ok], *(q[c].to_numpy() for c in ("x0", "y0", "x1", "y1")), margin)
        return p.append_column("distance", pa.array(d, pa.float64(), mask=np.isinf(d)))

    return find


def nearest_distances(points: DataFrame, segments: DataFrame, radius: float, by: str = "scene_id") -> DataFrame:
    """Points (by, x, y, ...) with the distance to their nearest segment (by, x0, y0, x1, y1), null beyond the radius.

    Points and the segments near them meet in blocks, where a fine grid finds the nearest one: no pair of both leaves a task. Blocks reach out by an eighth of the radius
    first; what finds nothing there meets the segments of the whole radius, of blocks that still have such points only.
    """
    from .geom import segment_distance

    out, rest = None, points
    result = StructType([*rest.schema.fields, StructField("distance", DoubleType())])
    names = rest.columns
    for side, margin in ((radius / 2, radius / 8), (2.0 * radius, float(radius))):
        at = [cell("x", side).alias("cx"), cell("y", side).alias("cy")]
        box = {"lx": F.least("x0", "x1"), "ly": F.least("y0", "y1"), "hx": F.greatest("x0", "x1"), "hy": F.greatest("y0", "y1")}
        s = segments.select(by, "x0", "y0", "x1", "y1").withColumns(box).withColumn("c", box_cells("lx", "ly", "hx", "hy", side, margin)).select(by, F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), "x0", "y0", "x1", "y1")
        # a line is not near all blocks that its box touches
        s = s.where(segment_distance((F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, "x0", "y0", "x1", "y1") <= side * 0.7072 + 1.4143 * margin)
        if out is not None:
            s = s.join(rest.select(by, *at).distinct(), [by, "cx", "cy"], "left_semi")

        keys = [by, "cx", "cy"]
        found = stored(rest.select("*", *at).groupBy(*keys).cogroup(s.groupBy(*keys)).applyInArrow(_finder(names, margin), result), "nearest")
        if side > radius:
            return out.unionByName(found)
        out, rest = found.where("distance is not null"), found.where("distance is null").drop("distance")
        if rest.isEmpty():
            return found
    return out
