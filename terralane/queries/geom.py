"""Geometry queries: polylines are the events of a user in time order (x = position, y = value); pairs are orders with their customers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import query
from ..functions import geom
from .inputs import CELLS, GRAPH, cells, rounded, segments

EV = "ev AS (SELECT user_id AS id, CAST(row_number() OVER w AS DOUBLE) AS x, value AS y, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
SG = EV + """, sg AS (SELECT id, k, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM ev WINDOW w AS (PARTITION BY id ORDER BY k)), st AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS l FROM sg WHERE x1 IS NOT NULL),
le AS (SELECT ev.id, coalesce(sum(l), 0) AS length FROM ev LEFT JOIN st USING (id, k) GROUP BY 1)"""
VEC = "ve AS (SELECT vec_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS byy, embedding[5]::DOUBLE AS cx, embedding[6]::DOUBLE AS cy, embedding[7]::DOUBLE AS dx, embedding[8]::DOUBLE AS dy FROM embeddings)"


def polylines(t):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ev = t.events.select(F.col("user_id").alias("id"), k.alias("k"), "value")
    return ev.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("p")).select("id", F.transform("p", lambda p: F.struct(p["k"].cast("double").alias("x"), p["value"].alias("y"))).alias("poly"))


def vectors(t):
    return t.embeddings.select("vec_id", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"))))


@query("e1_arc_length", f"WITH {SG} SELECT id, round(length, 6) AS length FROM le")
def _(t):
    return rounded(polylines(t).select("id", geom.arc_length(F.col("poly")).alias("length")))


PROJ = SG + """, pr AS (SELECT id, k, l, x0, y0, x1, y1, CASE WHEN l > 0 THEN greatest(0, least(1, ((3.5 - x0) * (x1 - x0) + (50 - y0) * (y1 - y0)) / (l * l))) ELSE 0 END AS t, coalesce(sum(l) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM st),
pd AS (SELECT id, k, x0 + t * (x1 - x0) AS x, y0 + t * (y1 - y0) AS y, before + t * l AS s FROM pr), pb AS (SELECT *, sqrt((x-3.5)*(x-3.5)+(y-50)*(y-50)) AS d FROM pd)"""


@query("e2_project", f"WITH {PROJ} SELECT id, round(min(d), 6) AS d, round(arg_min(x, d), 6) AS x, round(arg_min(y, d), 6) AS y, round(arg_min(s, d), 6) AS s FROM pb GROUP BY 1")
def _(t):
    p = polylines(t).where(F.size("poly") > 1).select("id", geom.project(3.5, 50.0, F.col("poly")).alias("p"))
    return rounded(p.select("id", "p.d", "p.x", "p.y", "p.s"))


@query("e3_angles", f"""WITH {VEC}, n AS (SELECT *, sqrt(ax*ax+ay*ay) AS la, sqrt(bx*bx+byy*byy) AS lb, ax*bx+ay*byy AS dot FROM ve) SELECT vec_id, round(CASE WHEN la > 0 AND lb > 0 THEN degrees(acos(greatest(-1, least(1, dot / (la * lb))))) ELSE 180 END, 5) AS directed, round(CASE WHEN la > 0 AND lb > 0 THEN degrees(acos(least(1, abs(dot) / (la * lb)))) ELSE 90 END, 5) AS axis FROM n""")
def _(t):
    return rounded(vectors(t).select("vec_id", geom.directed_angle("ax", "ay", "bx", "by").alias("directed"), geom.axis_angle("ax", "ay", "bx", "by").alias("axis")), 5)


@query("e4_resample", f"""WITH {PROJ}, q AS (SELECT id, length, unnest(range(0, 9)) AS i FROM le WHERE id IN (SELECT id FROM st)), g AS (SELECT id, k, l, x0, y0, x1, y1, before FROM pr),
m AS (SELECT q.id, i, g.*, row_number() OVER (PARTITION BY q.id, i ORDER BY g.k) AS n FROM q JOIN g ON q.id = g.id AND length * i / 8 <= before + l + 1e-9)
SELECT id, i, round(x0 + (x1 - x0) * CASE WHEN l > 0 THEN least(1, (length * i / 8 - before) / l) ELSE 0 END, 4) AS x, round(y0 + (y1 - y0) * CASE WHEN l > 0 THEN least(1, (length * i / 8 - before) / l) ELSE 0 END, 4) AS y FROM m JOIN le USING (id) WHERE n = 1""")
def _(t):
    return rounded(polylines(t).where(F.size("poly") > 1).select("id", F.posexplode(geom.resample(F.col("poly"), 9)).alias("i", "p")).select("id", "i", "p.x", "p.y"), 4)


@query("e4_sample_spacing", f"WITH RECURSIVE {GRAPH}, e AS (SELECT g.*, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM g JOIN pts p ON p.scene_id = g.scene_id AND p.id = u JOIN pts q ON q.scene_id = g.scene_id AND q.id = v), n AS (SELECT *, CAST(greatest(1, ceil(length / 4)) AS INT) AS n FROM e), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n) SELECT scene_id, u, v, k, round(x0 + (x1 - x0) * k / n, 6) AS x, round(y0 + (y1 - y0) * k / n, 6) AS y FROM k")
def _(t):
    from ..operators.evaluate import sample_lines

    return rounded(sample_lines(segments(t).withColumnRenamed("v", "segment"), 4.0, ["scene_id", "u"]).withColumnRenamed("segment", "v"))


@query("e5_oriented", f"WITH {EV}, f AS (SELECT id, arg_min(x, k) AS fx, arg_min(y, k) AS fy, arg_max(x, k) AS lx, arg_max(y, k) AS ly FROM ev GROUP BY 1) SELECT id, CASE WHEN sqrt((fx-10)*(fx-10)+(fy-20)*(fy-20)) > sqrt((lx-10)*(lx-10)+(ly-20)*(ly-20)) THEN lx ELSE fx END AS first_x FROM f")
def _(t):
    return polylines(t).select("id", geom.oriented(F.col("poly"), 10.0, 20.0)[0]["x"].alias("first_x"))


@query("e6_principal_direction", "WITH s AS (SELECT label, var_pop(embedding[1]::DOUBLE) AS xx, covar_pop(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS xy, var_pop(embedding[2]::DOUBLE) AS yy FROM embeddings GROUP BY 1), h AS (SELECT *, (xx + yy) / 2 AS mid, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS half FROM s) SELECT label, round(0.5 * atan2(2 * xy, xx - yy), 5) AS angle, round(1 - (mid - half) / (mid + half), 6) AS anisotropy FROM h")
def _(t):
    e = vectors(t).join(t.embeddings.select("vec_id", "label"), "vec_id")
    s = e.groupBy("label").agg(F.var_pop("ax").alias("xx"), F.covar_pop("ax", "ay").alias("xy"), F.var_pop("ay").alias("yy"))
    xx, xy, yy = F.col("xx"), F.col("xy"), F.col("yy")
    return s.select("label", F.round(geom.principal_angle(xx, xy, yy), 5).alias("angle"), F.round(geom.anisotropy(xx, xy, yy), 6).alias("anisotropy"))


@query("e7_crosses", f"WITH {VEC} SELECT vec_id, sign((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx)) * sign((dx-cx)*(byy-cy)-(dy-cy)*(bx-cx)) < 0 AND sign((bx-ax)*(cy-ay)-(byy-ay)*(cx-ax)) * sign((bx-ax)*(dy-ay)-(byy-ay)*(dx-ax)) < 0 AS crosses FROM ve")
def _(t):
    return vectors(t).select("vec_id", geom.crosses("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy").alias("crosses"))


@query("e8_box_distance", f"WITH {EV}, b AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ev GROUP BY 1) SELECT id, round(sqrt(greatest(100 - x1, x0 - 120, 0)**2 + greatest(-30 - y1, y0 + 20, 0)**2), 6) AS distance FROM b")
def _(t):
    b = polylines(t).select("id", F.explode("poly").alias("p")).groupBy("id").agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
    return rounded(b.select("id", geom.box_distance("x0", "y0", "x1", "y1", 100.0, -30.0, 120.0, -20.0).alias("distance")))


@query("e9_curvature", f"""WITH {SG}, tu AS (SELECT id, x1 - x0 AS ax, y1 - y0 AS ay, lead(x1 - x0) OVER w AS bx, lead(y1 - y0) OVER w AS byy FROM st WINDOW w AS (PARTITION BY id ORDER BY k)), an AS (SELECT id, degrees(acos(greatest(-1, least(1, (ax*bx+ay*byy) / (sqrt(ax*ax+ay*ay) * sqrt(bx*bx+byy*byy)))))) AS a FROM tu WHERE bx IS NOT NULL)
SELECT id, round(coalesce(avg(a), 0), 4) AS mean, round(coalesce(max(a), 0), 4) AS most, round(CASE WHEN any_value(length) > 0 THEN coalesce(sum(a), 0) / any_value(length) ELSE 0 END, 4) AS per_length FROM le LEFT JOIN an USING (id) GROUP BY 1""")
def _(t):
    return rounded(polylines(t).select("id", geom.curvature(F.col("poly")).alias("c")).select("id", "c.mean", "c.most", "c.per_length"), 4)


@query("e10_sliced_length", f"WITH {SG} SELECT id, round(length / 2, 4) AS length FROM le WHERE id IN (SELECT id FROM st)")
def _(t):
    p = polylines(t).where(F.size("poly") > 1)
    p = p.withColumn("full", geom.arc_length(F.col("poly"))).withColumn("part", geom.sliced(F.col("poly"), F.col("full") * 0.25, F.col("full") * 0.75))
    return rounded(p.select("id", geom.arc_length(F.col("part")).alias("length")), 4)


@query("e12_bilinear", f"""WITH {CELLS}, p AS (SELECT s_suppkey AS id, s_nationkey * 2.3 + 1 AS x, s_suppkey % 60 + 0.25 AS y FROM supplier), q AS (SELECT id, x, y, CAST(floor(x) AS BIGINT) + i AS cx, CAST(floor(y) AS BIGINT) + j AS cy, (CASE WHEN i = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * (CASE WHEN j = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) AS w FROM p, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT id, round(sum(w * value), 6) AS value FROM q JOIN cells c ON c.x = cx AND c.y = cy GROUP BY 1""")
def _(t):
    from ..operators.raster import bilinear

    p = t.supplier.select(F.lit(0).alias("scene_id"), F.col("s_suppkey").alias("id"), (F.col("s_nationkey") * 2.3 + 1).alias("x"), (F.col("s_suppkey") % 60 + 0.25).alias("y"))
    return rounded(bilinear(p, cells(t).withColumn("scene_id", F.lit(0))).select("id", "value"))


@query("e13_longest_run", f"WITH {EV}, r AS (SELECT id, y < 40 AS low, sum(CASE WHEN y < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY k) AS run FROM ev), c AS (SELECT id, run, count(*) FILTER (low) AS n FROM r GROUP BY 1, 2) SELECT id, CAST(max(n) AS INT) AS longest FROM c GROUP BY 1")
def _(t):
    return polylines(t).select("id", geom.longest_run(F.transform("poly", lambda p: p["y"] < 40)).alias("longest"))


ANG = EV + ", aa AS (SELECT id, (y * 7.3 + x * 31.7) % 360 AS a FROM ev), ga AS (SELECT id, a, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY id) + 360) - a AS gap FROM aa WINDOW w AS (PARTITION BY id ORDER BY a))"


def angles(t):
    return polylines(t).select("id", F.transform("poly", lambda p: F.pmod(p["y"] * 7.3 + p["x"] * 31.7, F.lit(360.0))).alias("angles"))


@query("e14_circular_mean", f"WITH {ANG}, m AS (SELECT id, degrees(atan2(sum(sin(radians(a))), sum(cos(radians(a))))) AS m FROM aa GROUP BY 1) SELECT id, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 4) AS mean FROM m")
def _(t):
    return rounded(angles(t).select("id", geom.circular_mean(F.col("angles")).alias("mean")), 4)


@query("e15_direction_groups", f"WITH {ANG} SELECT id, CAST(greatest(1, count(*) FILTER (gap > 30)) AS INT) AS groups, round(max(gap), 5) AS widest FROM ga GROUP BY 1")
def _(t):
    return rounded(angles(t).select("id", geom.direction_groups(F.col("angles"), 30.0).alias("groups"), F.array_max(geom.circular_gaps(F.col("angles"))).alias("widest")), 5)


@query("e16_axis_count")
def _(t):
    return angles(t).select("id", geom.axis_count(F.col("angles"), 15.0).alias("axes"))
