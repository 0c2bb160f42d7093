"""Corridor queries: least-cost paths over the part-supplier raster, seeds and splits over the point graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import corridors as op
from ..operators import proposals as pr
from ..operators.routing import corridor_cost
from .graph import COMP
from .inputs import CELLS, cells, edges, nodes, rounded

#: A pair of places for each embedding; a window holds at most 33 x 29 cells.
PAIRS = "pa AS (SELECT vec_id AS id, vec_id * 7 % 64 AS sx, vec_id * 13 % 64 AS sy, vec_id * 7 % 64 + vec_id % 21 - 10 AS gx, vec_id * 13 % 64 + vec_id % 17 - 8 AS gy FROM embeddings)"
MOVES = "mv AS (SELECT a.dx, b.dy, sqrt(a.dx * a.dx + b.dy * b.dy) AS s FROM (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy) WHERE a.dx <> 0 OR b.dy <> 0)"
#: Distances from the start disks, relaxed until nothing gets less; st holds the steps, w the windows.
RELAX = """d(id, x, y, c) USING KEY (id, x, y) AS (
  SELECT id, x, y, 0.0::DOUBLE FROM w JOIN co ON (x - sx)**2 + (y - sy)**2 <= {r2} AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1
  UNION
  SELECT n.id, n.x, n.y, n.c FROM (SELECT d.id, st.x2 AS x, st.y2 AS y, min(d.c + st.w) AS c FROM d JOIN st ON st.x = d.x AND st.y = d.y JOIN w ON w.id = d.id AND x2 BETWEEN x0 AND x1 AND y2 BETWEEN y0 AND y1 GROUP BY 1, 2, 3) n
  LEFT JOIN recurring.d r ON r.id = n.id AND r.x = n.x AND r.y = n.y WHERE r.c IS NULL OR n.c < r.c)"""


def pairs(t):
    i = F.col("vec_id")
    sx, sy = i * 7 % 64, i * 13 % 64
    return t.embeddings.select(F.lit(0).alias("scene_id"), i.alias("id"), sx.alias("sx"), sy.alias("sy"), (sx + i % 21 - 10).alias("gx"), (sy + i % 17 - 8).alias("gy"))


def costs(t):
    return cells(t).select(F.lit(0).alias("scene_id"), "x", "y", corridor_cost(F.col("value"), 8.0, 2.0, 4.0, 0.45).alias("cost"))


def walked(paths, raster):
    """The cost of each path, summed over its steps."""
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("p"), F.get("path", i).alias("q"))))
    s = paths.where(F.size("path") > 1).select("scene_id", "id", step.alias("s"))
    at = lambda e: raster.select("scene_id", F.col("x").cast("long").alias(f"{e}x"), F.col("y").cast("long").alias(f"{e}y"), F.col("cost").alias(f"{e}c"))
    s = s.select("scene_id", "id", *(F.col(f"s.{e}.{c}").alias(f"{e}{c}") for e in "pq" for c in "xy"))
    s = s.join(at("p"), ["scene_id", "px", "py"]).join(at("q"), ["scene_id", "qx", "qy"])
    way = F.sqrt((F.col("px") - F.col("qx")) ** 2 + (F.col("py") - F.col("qy")) ** 2) * (F.col("pc") + F.col("qc")) / 2
    return s.groupBy("scene_id", "id").agg(F.sum(way).alias("walked"))


@query("h18_corridors", f"""WITH RECURSIVE {CELLS}, co AS (SELECT x, y, 1 + 8 * power(1 - value, 2) + CASE WHEN value < 0.45 THEN 4 ELSE 0 END AS c FROM cells), {PAIRS},
w AS (SELECT *, least(sx, gx) - 6 AS x0, greatest(sx, gx) + 6 AS x1, least(sy, gy) - 6 AS y0, greatest(sy, gy) + 6 AS y1 FROM pa), {MOVES},
st AS (SELECT a.x, a.y, a.x + dx AS x2, a.y + dy AS y2, s * (a.c + b.c) / 2 AS w FROM co a, mv, co b WHERE b.x = a.x + dx AND b.y = a.y + dy), {RELAX.format(r2=4)}
SELECT w.id, min(d.c) IS NOT NULL AS found, round(min(d.c), 6) AS cost, round(coalesce(min(d.c), 0), 6) AS walked FROM w LEFT JOIN d ON d.id = w.id AND (d.x - gx)**2 + (d.y - gy)**2 <= 4 GROUP BY 1""")
def _(t):
    out = op.least_cost_paths(pairs(t), costs(t), 6.0, 2.0, tile=32)
    out = out.join(walked(out, costs(t)), ["scene_id", "id"], "left").fillna({"walked": 0.0})
    return rounded(out.select("id", "found", "cost", "walked"))


@query("j5_grid_routes", f"""WITH RECURSIVE {CELLS}, co AS (SELECT x, y, 1 AS c FROM cells WHERE value >= 0.48), {PAIRS}, w AS (SELECT *, 0 AS x0, 63 AS x1, 0 AS y0, 63 AS y1 FROM pa), {MOVES},
st AS (SELECT a.x, a.y, a.x + dx AS x2, a.y + dy AS y2, s AS w FROM co a, mv, co b WHERE b.x = a.x + dx AND b.y = a.y + dy AND EXISTS (SELECT 1 FROM co c WHERE c.x = a.x + dx AND c.y = a.y) AND EXISTS (SELECT 1 FROM co c WHERE c.x = a.x AND c.y = a.y + dy)), {RELAX.format(r2=0)},
e AS (SELECT pa.*, s.value AS sv, g.value AS gv FROM pa LEFT JOIN cells s ON s.x = sx AND s.y = sy LEFT JOIN cells g ON g.x = gx AND g.y = gy)
SELECT e.id, d.c IS NOT NULL AS found, round(d.c, 6) AS length, CASE WHEN d.c IS NOT NULL THEN NULL WHEN sv IS NULL OR gv IS NULL THEN 'endpoint_out_of_bounds' WHEN sv < 0.48 OR gv < 0.48 THEN 'endpoint_blocked' ELSE 'disconnected' END AS reason
FROM e LEFT JOIN d ON d.id = e.id AND d.x = gx AND d.y = gy""")
def _(t):
    raster = cells(t).select(F.lit(0).alias("scene_id"), "x", "y", "value")
    return rounded(op.grid_routes(pairs(t), raster, 0.48).select("id", "found", "length", "reason"))


BOXES = COMP + """, bx AS (SELECT scene_id, component, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM co JOIN pts USING (scene_id, id) GROUP BY 1, 2),
nb AS (SELECT p.scene_id, p.component AS p, q.component AS q, sqrt(greatest(p.x0 - q.x1, q.x0 - p.x1, 0)**2 + greatest(p.y0 - q.y1, q.y0 - p.y1, 0)**2) AS d FROM bx p JOIN bx q ON p.scene_id = q.scene_id AND p.component <> q.component),
nk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, p ORDER BY round(d, 9), q) AS k FROM nb WHERE d <= 250),
cp AS (SELECT DISTINCT scene_id, least(p, q) AS a, greatest(p, q) AS b FROM nk WHERE k <= 10),
ep AS (SELECT dg.scene_id, dg.id, component FROM dg JOIN co USING (scene_id, id) WHERE degree = 1),
xt AS (SELECT scene_id, component, unnest([arg_min(id, (x, id)), arg_min(id, (-x, id)), arg_min(id, (y, id)), arg_min(id, (-y, id))]) AS id FROM co JOIN pts USING (scene_id, id) WHERE (scene_id, component) NOT IN (SELECT (scene_id, component) FROM ep) GROUP BY 1, 2),
se AS (SELECT DISTINCT scene_id, s.id, component, x, y FROM (SELECT scene_id, id, component FROM ep UNION ALL SELECT scene_id, id, component FROM xt) s JOIN pts USING (scene_id, id)),
nn AS (SELECT a.scene_id, a.component AS a, b.component AS b, 0 AS kind, a.component AS source_component, a.id AS source, b.component AS target_component, b.id AS target, NULL::BIGINT AS u, NULL::BIGINT AS v, NULL::DOUBLE AS t, a.x AS sx, a.y AS sy, b.x AS gx, b.y AS gy, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance FROM se a JOIN se b ON a.scene_id = b.scene_id AND a.component < b.component),
sg AS (SELECT g.scene_id, u, v, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, component AS other FROM g JOIN pts p ON p.scene_id = g.scene_id AND p.id = u JOIN pts q ON q.scene_id = g.scene_id AND q.id = v JOIN co ON co.scene_id = g.scene_id AND co.id = u),
tt AS (SELECT se.*, u, v, x0, y0, x1, y1, other, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) AS t FROM se JOIN sg ON se.scene_id = sg.scene_id AND component <> other),
dn AS (SELECT *, x0 + t * (x1-x0) AS gx, y0 + t * (y1-y0) AS gy, sqrt((x - x0 - t * (x1-x0))**2 + (y - y0 - t * (y1-y0))**2) AS distance FROM tt),
ne AS (SELECT scene_id, least(component, other) AS a, greatest(component, other) AS b, 1 AS kind, component AS source_component, id AS source, other AS target_component, NULL::BIGINT AS target, u, v, t, x AS sx, y AS sy, gx, gy, distance FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id, other ORDER BY round(distance, 9), u, v) AS k FROM dn) WHERE k = 1),
al AS (SELECT * FROM nn UNION ALL SELECT * FROM ne), o AS (SELECT *, row_number() OVER (PARTITION BY scene_id, a, b, round_even(sx, 1), round_even(sy, 1), round_even(gx, 1), round_even(gy, 1) ORDER BY round(distance, 9), kind, source_component, source, target, u, v) AS k FROM al JOIN cp USING (scene_id, a, b) WHERE distance <= 250),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene_id, a, b ORDER BY round(distance, 9), kind, source_component, source, target NULLS FIRST, u, v) AS rank FROM o WHERE k = 1)"""


def seeds(t):
    return op.seed_pairs(pr.component_pairs(nodes(t), edges(t), 250.0, 10), nodes(t), edges(t))


@query("h16_seed_pairs", BOXES + " SELECT scene_id, a, b, rank, source_component, source, target_component, target, u, v, round(sx, 6) AS sx, round(sy, 6) AS sy, round(gx, 6) AS gx, round(gy, 6) AS gy, round(distance, 6) AS distance FROM rk WHERE rank <= 6 AND distance >= 2")
def _(t):
    return rounded(seeds(t).drop("t"))


@query("h19_split_corridors")
def _(t):
    # straight corridors between the seeds; their parts end where they meet other components
    line = F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("gx").alias("x"), F.col("gy").alias("y")))
    paths = seeds(t).select("scene_id", F.struct("a", "b", "rank").alias("id"), F.col("source_component").alias("a"), F.col("target_component").alias("b"), line.alias("polyline"))
    none = cells(t).select(F.lit(-1).cast("int").alias("scene_id"), "x", "y", "value")
    out = op.split_corridors(paths, nodes(t), edges(t), none)
    return rounded(out.select("scene_id", F.col("id.a").alias("pa"), F.col("id.b").alias("pb"), F.col("id.rank").alias("rank"), "part", "a", "b", "start", "stop", "length", F.size("stops").alias("stops"), F.array_join("rejection_flags", ",").alias("flags"), "status"))
