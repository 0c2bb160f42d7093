"""Geometry as column expressions. A polyline is array<struct<x, y>>; y points down; angles are in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(float(v))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return F.sqrt(dx * dx + dy * dy)


def steps(poly: Column) -> Column:
    """The vectors between consecutive points: array<struct<dx, dy, l>>."""
    n = F.size(poly)
    vec = lambda p, q: F.struct((q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"), distance(p["x"], p["y"], q["x"], q["y"]).alias("l"))
    return F.when(n > 1, F.zip_with(F.slice(poly, 1, n - 1), F.slice(poly, 2, n - 1), vec))


def arc_length(poly: Column) -> Column:
    """Length of a polyline; 0 for fewer than two points."""
    return F.coalesce(F.aggregate(steps(poly), F.lit(0.0), lambda acc, s: acc + s["l"]), F.lit(0.0))


def segment_place(px, py, x0, y0, x1, y1) -> Column:
    """Where along a segment the closest point to p lies, 0 to 1; 0 for a segment without length."""
    px, py, x0, y0, x1, y1 = map(_c, (px, py, x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    l2 = dx * dx + dy * dy
    return F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x0) * dx + (py - y0) * dy) / l2))).otherwise(0.0)


def segment_distance(px, py, x0, y0, x1, y1) -> Column:
    px, py, x0, y0, x1, y1 = map(_c, (px, py, x0, y0, x1, y1))
    t = segment_place(px, py, x0, y0, x1, y1)
    return distance(px, py, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


def project(px, py, poly: Column) -> Column:
    """The closest point of a polyline: struct<d, x, y, s>, s the arc length up to it; the first of equally close ones."""
    px, py = _c(px), _c(py)
    n = F.size(poly)
    seg = lambda p, q: F.struct(p.alias("p"), q.alias("q"))

    def closest(acc, s):
        t = segment_place(px, py, s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])
        x, y = s["p"]["x"] + t * (s["q"]["x"] - s["p"]["x"]), s["p"]["y"] + t * (s["q"]["y"] - s["p"]["y"])
        length = distance(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"])
        d = distance(px, py, x, y)
        best = F.when(d < acc["best"]["d"], F.struct(d.alias("d"), x.alias("x"), y.alias("y"), (acc["at"] + t * length).alias("s"))).otherwise(acc["best"])
        return F.struct((acc["at"] + length).alias("at"), best.alias("best"))

    inf = F.lit(math.inf)
    start = F.struct(F.lit(0.0).alias("at"), F.struct(inf.alias("d"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("s")).alias("best"))
    return F.aggregate(F.zip_with(F.slice(poly, 1, n - 1), F.slice(poly, 2, n - 1), seg), start, closest, lambda acc: acc["best"])


def directed_angle(ax, ay, bx, by) -> Column:
    """Angle between two vectors, 0 to 180; 180 where one has no length."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return F.when((la > 0) & (lb > 0), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / (la * lb)))))).otherwise(180.0)


def axis_angle(ax, ay, bx, by) -> Column:
    """Angle between two lines, 0 to 90; 90 where one has no length."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    return F.when((la > 0) & (lb > 0), F.degrees(F.acos(F.least(F.lit(1.0), F.abs(ax * bx + ay * by) / (la * lb))))).otherwise(90.0)


def _point_at(poly: Column, s: Column) -> Column:
    """The point at arc length s: the segments are walked until s is used up."""
    n = F.size(poly)
    seg = lambda p, q: F.struct(p.alias("p"), q.alias("q"))

    def walk(acc, g):
        length = distance(g["p"]["x"], g["p"]["y"], g["q"]["x"], g["q"]["y"])
        t = F.when(length > 0, F.least(F.lit(1.0), acc["left"] / length)).otherwise(0.0)
        x, y = g["p"]["x"] + t * (g["q"]["x"] - g["p"]["x"]), g["p"]["y"] + t * (g["q"]["y"] - g["p"]["y"])
        here = acc["left"] >= 0
        return F.struct(F.when(here & (acc["left"] > length), acc["left"] - length).when(here, F.lit(-1.0)).otherwise(acc["left"]).alias("left"), F.when(here, x).otherwise(acc["x"]).alias("x"), F.when(here, y).otherwise(acc["y"]).alias("y"))

    start = F.struct(s.cast("double").alias("left"), poly[0]["x"].alias("x"), poly[0]["y"].alias("y"))
    return F.aggregate(F.zip_with(F.slice(poly, 1, n - 1), F.slice(poly, 2, n - 1), seg), start, walk, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def resample(poly: Column, n: int | Column) -> Column:
    """n points at equal arc distances, both ends included."""
    n = F.lit(n) if isinstance(n, int) else n
    length = arc_length(poly)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _point_at(poly, length * i / F.greatest(n - 1, F.lit(1))))


def sample_steps(x0, y0, x1, y1, spacing: float) -> Column:
    """Number of steps of at most `spacing` along a segment, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(distance(x0, y0, x1, y1) / spacing)).cast("int")


def sample_spacing(x0, y0, x1, y1, spacing: float) -> Column:
    """Points along a segment at most `spacing` apart, both ends included."""
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    n = sample_steps(x0, y0, x1, y1, spacing)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((x0 + (x1 - x0) * i / n).alias("x"), (y0 + (y1 - y0) * i / n).alias("y")))


def oriented(poly: Column, x, y) -> Column:
    """The polyline from the end that is nearer to (x, y); as it is where both are equally near."""
    first, last = poly[0], F.element_at(poly, -1)
    return F.when(distance(first["x"], first["y"], x, y) > distance(last["x"], last["y"], x, y), F.reverse(poly)).otherwise(poly)


def principal_angle(cxx: Column, cxy: Column, cyy: Column) -> Column:
    """Direction of the larger axis of a 2 x 2 covariance, in radians."""
    return 0.5 * F.atan2(2 * cxy, cxx - cyy)


def anisotropy(cxx: Column, cxy: Column, cyy: Column) -> Column:
    """1 - smaller / larger eigenvalue of a 2 x 2 covariance; 0 without spread."""
    mid, half = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    return F.when(mid + half > 0, 1 - F.greatest(mid - half, F.lit(0.0)) / (mid + half)).otherwise(0.0)


def side_of(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    ax, ay, bx, by, cx, cy = map(_c, (ax, ay, bx, by, cx, cy))
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(a0x, a0y, a1x, a1y, b0x, b0y, b1x, b1y) -> Column:
    """Whether two segments cross inside both; touching and collinear ones don't."""
    d1, d2 = side_of(b0x, b0y, b1x, b1y, a0x, a0y), side_of(b0x, b0y, b1x, b1y, a1x, a1y)
    d3, d4 = side_of(a0x, a0y, a1x, a1y, b0x, b0y), side_of(a0x, a0y, a1x, a1y, b1x, b1y)
    return (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)


def box_distance(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = map(_c, (ax0, ay0, ax1, ay1, bx0, by0, bx1, by1))
    zero = F.lit(0.0)
    dx, dy = F.greatest(bx0 - ax1, ax0 - bx1, zero), F.greatest(by0 - ay1, ay0 - by1, zero)
    return F.sqrt(dx * dx + dy * dy)


def turning(poly: Column) -> Column:
    """Angles between consecutive steps, in degrees; empty for fewer than three points."""
    s = steps(poly)
    n = F.size(s)
    return F.when(n > 1, F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: directed_angle(a["dx"], a["dy"], b["dx"], b["dy"]))).otherwise(F.array().cast("array<double>"))


def curvature(poly: Column) -> Column:
    """struct<mean, most, per_length> of the turning angles; zeros without any."""
    t = turning(poly)
    n, total, length = F.size(t), F.aggregate(t, F.lit(0.0), lambda a, v: a + v), arc_length(poly)
    return F.struct(F.when(n > 0, total / n).otherwise(0.0).alias("mean"), F.coalesce(F.array_max(t), F.lit(0.0)).alias("most"), F.when(length > 0, total / length).otherwise(0.0).alias("per_length"))


def sliced(poly: Column, s0: Column, s1: Column) -> Column:
    """The part of a polyline between two arc lengths, with points put in at both.

    One walk counts the points up to s0 and those before s1, which bound the inner ones: arc lengths grow along the line.
    """
    counts = F.aggregate(
        poly,
        F.struct(
            F.lit(0.0).alias("at"), F.lit(None).cast("struct<x:double,y:double>").alias("last"), F.lit(0).alias("upto"), F.lit(0).alias("before"),
            s0.cast("double").alias("s0"), s1.cast("double").alias("s1"),
        ),
        lambda acc, p: _counted(acc, p, acc["at"] + F.coalesce(distance(acc["last"]["x"], acc["last"]["y"], p["x"], p["y"]), F.lit(0.0))),
        lambda acc: F.struct(acc["upto"].alias("upto"), F.greatest(acc["before"] - acc["upto"], F.lit(0)).alias("n")),
    )
    # the counts stand once in an array of one, else the walk is made anew for each use
    inner = F.flatten(F.transform(F.array(counts), lambda c: F.slice(poly, c["upto"] + 1, c["n"])))
    inner = F.transform(inner, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.concat(F.array(_point_at(poly, s0)), inner, F.array(_point_at(poly, s1)))


def _counted(acc: Column, p: Column, at: Column) -> Column:
    count = lambda c, hit: (acc[c] + F.when(hit, 1).otherwise(0)).alias(c)
    return F.struct(
        at.alias("at"), F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")).alias("last"), count("upto", at <= acc["s0"]), count("before", at < acc["s1"]),
        acc["s0"].alias("s0"), acc["s1"].alias("s1"),
    )


def longest_run(flags: Column) -> Column:
    """The most consecutive true values of an array."""
    step = lambda acc, f: F.struct(F.when(f, acc["run"] + 1).otherwise(0).alias("run"), F.greatest(acc["most"], F.when(f, acc["run"] + 1).otherwise(0)).alias("most"))
    return F.aggregate(flags, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def circular_mean(angles: Column) -> Column:
    """Mean direction of angles in degrees, 0 to 360."""
    s = F.aggregate(angles, F.lit(0.0), lambda a, v: a + F.sin(F.radians(v)))
    c = F.aggregate(angles, F.lit(0.0), lambda a, v: a + F.cos(F.radians(v)))
    return F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0))


def circular_gaps(angles: Column) -> Column:
    """The gaps between neighbouring angles around the circle, in ascending order of the angles; the last one wraps around."""
    a = F.array_sort(F.transform(angles, lambda v: F.pmod(v, F.lit(360.0))))
    n = F.size(a)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.get(a, i) - F.get(a, i - 1)).otherwise(F.get(a, F.lit(0)) + 360.0 - F.get(a, n - 1)))


def direction_groups(angles: Column, separation: float) -> Column:
    """Number of groups of angles that gaps over the separation keep apart; 1 at least, 0 without angles."""
    return F.when(F.size(angles) == 0, 0).otherwise(F.greatest(F.lit(1), F.size(F.filter(circular_gaps(angles), lambda g: g > separation))))


def axis_count(angles: Column, tolerance: float) -> Column:
    """Number of lines among angles: folded to half a turn, each further than the tolerance from all lines before it counts."""
    folded = F.array_sort(F.transform(angles, lambda v: F.pmod(v, F.lit(180.0))))
    apart = lambda v, k: F.least(F.abs(v - k), 180.0 - F.abs(v - k)) > tolerance
    return F.aggregate(folded, F.array().cast("array<double>"), lambda acc, v: F.when(F.forall(acc, lambda k: apart(v, k)), F.concat(acc, F.array(v))).otherwise(acc), F.size)


def nearest_cell(v: Column) -> Column:
    """Cell of a coordinate, halves to even."""
    return F.rint(v).cast("int")
