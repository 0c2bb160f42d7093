"""Routing and proposal queries over the point graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import proposals as pr
from ..operators import routing as op
from .graph import COMP, TABLE, W
from .inputs import CELLS, cells, edges, nodes, rounded

PAIRS = W + """, ed AS (SELECT g.*, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM g JOIN pts p ON p.scene_id = g.scene_id AND p.id = u JOIN pts q ON q.scene_id = g.scene_id AND q.id = v),
pa AS (SELECT a.scene_id, a.id, a.x + 3 AS sx, a.y - 2 AS sy, b.x - 1 AS gx, b.y + 4 AS gy FROM pts a JOIN (SELECT scene_id, id, lead(id, 2) OVER (PARTITION BY scene_id ORDER BY id) AS nx FROM pts) n USING (scene_id, id) JOIN pts b ON b.scene_id = a.scene_id AND b.id = nx),
en AS (SELECT scene_id, id, 's' AS e, sx AS x, sy AS y FROM pa UNION ALL SELECT scene_id, id, 'g', gx, gy FROM pa),
tt AS (SELECT en.scene_id, id, e, u, v, x, y, x0, y0, x1, y1, length, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / nullif((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0), 0))) AS t FROM en JOIN ed USING (scene_id)),
dd AS (SELECT *, sqrt((x - x0 - coalesce(t, 0) * (x1-x0))**2 + (y - y0 - coalesce(t, 0) * (y1-y0))**2) AS distance FROM tt),
pj AS (SELECT scene_id, id, e, u, v, coalesce(t, 0) AS t, distance, length FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, id, e ORDER BY round(distance, 9), u, v) AS k FROM dd WHERE distance <= 40) WHERE k = 1)"""
#: Shortest distances of each pair to nodes, relaxed until nothing gets less, then what routes give.
PATHS = "WITH RECURSIVE " + PAIRS.removeprefix("WITH RECURSIVE ").removeprefix("WITH ") + """,
d(scene_id, id, node, c) USING KEY (scene_id, id, node) AS (
  SELECT scene_id, id, node, min(c) FROM (SELECT scene_id, id, u AS node, t * length AS c FROM pj WHERE e = 's' UNION ALL SELECT scene_id, id, v, (1 - t) * length FROM pj WHERE e = 's') GROUP BY 1, 2, 3
  UNION
  SELECT n.scene_id, n.id, n.node, n.c FROM (SELECT d.scene_id, d.id, bo.other AS node, min(d.c + bo.length) AS c FROM d JOIN bo ON bo.scene_id = d.scene_id AND bo.id = d.node GROUP BY 1, 2, 3) n
  LEFT JOIN recurring.d r ON r.scene_id = n.scene_id AND r.id = n.id AND r.node = n.node WHERE r.c IS NULL OR n.c < r.c - 1e-12),
ar AS (SELECT d.scene_id, d.id, d.c + CASE WHEN d.node = pj.u THEN pj.t * pj.length ELSE (1 - pj.t) * pj.length END AS c FROM d JOIN pj ON pj.scene_id = d.scene_id AND pj.id = d.id AND pj.e = 'g' AND d.node IN (pj.u, pj.v)
  UNION ALL SELECT a.scene_id, a.id, abs(a.t - b.t) * a.length FROM pj a JOIN pj b ON a.scene_id = b.scene_id AND a.id = b.id AND a.e = 's' AND b.e = 'g' AND a.u = b.u AND a.v = b.v),
bs AS (SELECT scene_id, id, min(c) AS length FROM ar GROUP BY 1, 2),
rs AS (SELECT pa.scene_id, pa.id, bs.length IS NOT NULL AS success, bs.length, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'projection' WHEN bs.length IS NULL THEN 'disconnected' END AS failure
  FROM pa LEFT JOIN bs ON bs.scene_id = pa.scene_id AND bs.id = pa.id LEFT JOIN pj a ON a.scene_id = pa.scene_id AND a.id = pa.id AND a.e = 's' LEFT JOIN pj b ON b.scene_id = pa.scene_id AND b.id = pa.id AND b.e = 'g')"""


def pairs(t):
    from pyspark.sql.window import Window

    n = nodes(t)
    nx = n.withColumn("nx", F.lead("id", 2).over(Window.partitionBy("scene_id").orderBy("id")))
    b = n.select("scene_id", F.col("id").alias("nx"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return nx.join(b, ["scene_id", "nx"]).select("scene_id", "id", (F.col("x") + 3).alias("sx"), (F.col("y") - 2).alias("sy"), (F.col("bx") - 1).alias("gx"), (F.col("by") + 4).alias("gy"))


def results(t):
    return op.scene_routes(op.attach(pairs(t), nodes(t), edges(t), 40.0), edges(t))


def project_starts(t, rows):
    p = rows.select("scene_id", "id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    return rounded(op.project_points(p, nodes(t), edges(t), 40.0))


@query("j1_project_points", PAIRS + " SELECT scene_id, id, u, v, round(t, 6) AS t, round(distance, 6) AS distance FROM pj WHERE e = 's'")
def _(t):
    return project_starts(t, pairs(t))


@query("j1_project_all_points", PAIRS + " SELECT scene_id, id, e, u, v, round(t, 6) AS t, round(distance, 6) AS distance FROM pj")
def _(t):
    return rounded(op.both_projections(pairs(t), nodes(t), edges(t), 40.0))


@query("j2_edge_cost", W + " SELECT scene_id, u, v, round(length * (1 + 2 * (1 - CASE WHEN u % 4 = 0 THEN 1 ELSE (v % 10) / 10 END)), 6) AS cost FROM g")
def _(t):
    conf = F.when(F.col("u") % 4 != 0, (F.col("v") % 10) / 10)
    return rounded(edges(t).select("scene_id", "u", "v", op.edge_cost(F.col("length"), conf, 2.0).alias("cost")))


@query("j3_routes", PATHS + " SELECT scene_id, id, success, round(length, 6) AS length, failure, round(length, 6) AS walked FROM rs")
def _(t):
    """walked: the length of the edges of the path and of the ways to its ends."""
    at = op.attach(pairs(t), nodes(t), edges(t), 40.0)
    out = op.scene_routes(at, edges(t))
    e = edges(t).select("scene_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("length").alias("w"))
    step = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.least(F.get("path", i - 1), F.get("path", i)).alias("u"), F.greatest(F.get("path", i - 1), F.get("path", i)).alias("v"))))
    inner = out.where(F.size("path") > 1).select("scene_id", "id", step.alias("s")).select("scene_id", "id", "s.u", "s.v").join(e, ["scene_id", "u", "v"]).groupBy("scene_id", "id").agg(F.sum("w").alias("inner"))
    rows = out.join(at.select("scene_id", "id", "s", "g"), ["scene_id", "id"]).join(inner, ["scene_id", "id"], "left")
    for c, node in (("s", F.get("path", F.lit(0))), ("g", F.element_at("path", -1))):
        rows = rows.withColumn(f"{c}u", F.col(f"{c}.u")).withColumn(f"{c}v", F.col(f"{c}.v"))
        rows = rows.join(e.select("scene_id", F.col("u").alias(f"{c}u"), F.col("v").alias(f"{c}v"), F.col("w").alias(f"{c}w")), ["scene_id", f"{c}u", f"{c}v"], "left")
        rows = rows.withColumn(f"{c}d", F.when(F.size("path") > 0, F.when(node == F.col(f"{c}.u"), F.col(f"{c}.t")).otherwise(1 - F.col(f"{c}.t")) * F.col(f"{c}w")))
    straight = F.abs(F.col("s.t") - F.col("g.t")) * F.col("sw")
    walked = F.when(F.size("path") > 0, F.col("sd") + F.col("gd") + F.coalesce("inner", F.lit(0.0))).when(F.col("success"), straight)
    return rounded(rows.select("scene_id", "id", "success", "length", "failure", walked.alias("walked")))


@query("j4_route_summary", PATHS + """ SELECT scene_id, count(*) AS pairs, round(avg(success::INT), 6) AS success_rate, round(avg(success::INT) FILTER (id % 2 = 0), 6) AS reachable_rate, count(*) FILTER (failure = 'projection') AS projection_failures, count(*) FILTER (failure = 'disconnected') AS disconnected, round(avg(length) FILTER (success), 6) AS mean_length FROM rs GROUP BY 1""")
def _(t):
    return rounded(op.route_summary(results(t).withColumn("expected_reachable", F.col("id") % 2 == 0), ["scene_id"]))


@query("j5_grid_edges", f"""WITH {CELLS}, f AS (SELECT x, y FROM cells WHERE value >= 0.48), o AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) v(dx, dy)),
e AS (SELECT f.x, f.y, f.x + dx AS x2, f.y + dy AS y2, dx, dy FROM f, o WHERE EXISTS (SELECT 1 FROM f b WHERE b.x = f.x + dx AND b.y = f.y + dy) AND (dx = 0 OR dy = 0 OR (EXISTS (SELECT 1 FROM f b WHERE b.x = f.x + dx AND b.y = f.y) AND EXISTS (SELECT 1 FROM f b WHERE b.x = f.x AND b.y = f.y + dy))))
SELECT least(y * 4294967296 + x, y2 * 4294967296 + x2) AS u, greatest(y * 4294967296 + x, y2 * 4294967296 + x2) AS v, round(sqrt(dx * dx + dy * dy), 6) AS length FROM e""")
def _(t):
    return rounded(op.grid_edges(cells(t).withColumn("scene_id", F.lit(0)), 0.48).drop("scene_id"))


@query("j8_outcome_examples", PATHS + """, oc AS (SELECT *, CASE WHEN success THEN 'success' ELSE failure END AS outcome FROM rs) SELECT scene_id, id, success, round(length, 6) AS length, failure, outcome FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, outcome ORDER BY id) AS k FROM oc) WHERE k = 1""")
def _(t):
    return rounded(op.outcome_examples(results(t).drop("path"), ["scene_id"]))


@query("h1_disconnected_sources", TABLE + ", m AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY nodes DESC, component) AS k FROM ct) SELECT scene_id, component, nodes, endpoints, edges, round(length, 6) AS length, false AS is_main FROM m WHERE k > 1 AND nodes <= 6 AND length <= 200")
def _(t):
    return rounded(pr.mine_disconnected(nodes(t), edges(t), 6, 200.0))


@query("h3_source_inventory", TABLE + ", m AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY nodes DESC, component) AS k FROM ct) SELECT scene_id, component, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (degree = 1), '') AS ends FROM m JOIN co USING (scene_id, component) JOIN dg USING (scene_id, id) WHERE k > 1 AND m.nodes <= 6 AND m.length <= 200 GROUP BY 1, 2")
def _(t):
    s = pr.source_inventory(nodes(t), edges(t), pr.mine_disconnected(nodes(t), edges(t), 6, 200.0))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return s.select("scene_id", "component", join("members"), join("ends"))


@query("h4_propose_v1", COMP + """, se AS (SELECT dg.scene_id, dg.id, component AS own, x, y FROM dg JOIN co USING (scene_id, id) JOIN pts USING (scene_id, id) WHERE degree = 1), ed AS (SELECT g.*, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1, component AS oc FROM g JOIN pts p ON p.scene_id = g.scene_id AND p.id = u JOIN pts q ON q.scene_id = g.scene_id AND q.id = v JOIN co ON co.scene_id = g.scene_id AND co.id = u),
tt AS (SELECT se.scene_id, own, id, u, v, x, y, x0, y0, x1, y1, greatest(0, least(1, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))) AS t FROM se JOIN ed ON se.scene_id = ed.scene_id AND own <> oc),
c AS (SELECT scene_id, own, id, 'edge' AS kind, u, v, x0 + t * (x1-x0) AS px, y0 + t * (y1-y0) AS py, sqrt((x - x0 - t * (x1-x0))**2 + (y - y0 - t * (y1-y0))**2) AS distance FROM tt UNION ALL SELECT a.scene_id, a.own, a.id, 'endpoint', b.id, b.id, b.x, b.y, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) FROM se a JOIN se b ON a.scene_id = b.scene_id AND a.own <> b.own),
n AS (SELECT *, row_number() OVER (PARTITION BY scene_id, own, id, round(px, 3), round(py, 3) ORDER BY kind, u, v) AS q FROM c WHERE distance <= 90), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, own, id ORDER BY round(distance, 9), kind, u, v) AS rank FROM n WHERE q = 1)
SELECT scene_id, own AS source, id, kind, u, v, round(distance, 6) AS distance, rank, 's' || own || '_e' || id || '_' || lpad(CAST(rank AS VARCHAR), 3, '0') AS proposal_id FROM r WHERE rank <= 5""")
def _(t):
    from ..operators.graph import components, degrees

    s = degrees(nodes(t), edges(t)).where("endpoint").select("scene_id", "id").join(components(nodes(t), edges(t)).withColumnRenamed("component", "source"), ["scene_id", "id"])
    return rounded(pr.propose_v1(s, nodes(t), edges(t), 90.0, 5).drop("px", "py"))


@query("h6_endpoint_pairs", W + ", e AS (SELECT dg.scene_id, dg.id, x, y FROM dg JOIN pts USING (scene_id, id) WHERE degree = 1) SELECT a.scene_id, a.id AS a, b.id AS b, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2), 6) AS distance FROM e a JOIN e b ON a.scene_id = b.scene_id AND a.id < b.id WHERE sqrt((a.x-b.x)**2 + (a.y-b.y)**2) <= 80 AND NOT EXISTS (SELECT 1 FROM g WHERE g.scene_id = a.scene_id AND u = a.id AND v = b.id)")
def _(t):
    return rounded(pr.propose_ends(nodes(t), edges(t), 80.0))


@query("h9_dedup", W + ", c AS (SELECT scene_id, id AS a, other AS b, length, u2 FROM (SELECT *, id AS u2 FROM bo)), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, least(a, b), greatest(a, b) ORDER BY a) AS k, count(*) OVER (PARTITION BY scene_id, least(a, b), greatest(a, b)) AS duplicates FROM c) SELECT scene_id, a, b, duplicates FROM k WHERE k = 1")
def _(t):
    from ..operators.graph import both_ends

    rows = both_ends(edges(t)).withColumnsRenamed({"id": "a", "other": "b"}).withColumn("kind", F.lit("endpoint"))
    return pr.dedup(rows, "kind", "a", "b", [F.col("a")]).select("scene_id", "a", "b", "duplicates")


@query("h12_score_gate_budget", W + """, s AS (SELECT scene_id, u AS a, v AS b, 0.15 * (1 - length / 60) + 0.2 * (u % 10) / 10 + 0.4 * (v % 7) / 7 + 0.15 * 0.5 + 0.1 * 1.0 AS score, length FROM g),
f AS (SELECT *, CASE WHEN length > 55 THEN 'length' END AS f1, CASE WHEN score < 0.4 THEN 'score' END AS f2 FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, a ORDER BY round(score, 9) DESC, b) AS k FROM f)
SELECT scene_id, a, b, round(score, 6) AS score, concat_ws(',', f1, f2) AS flags, CASE WHEN f1 IS NULL AND f2 IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM k WHERE k <= 5""")
def _(t):
    return rounded(pr.budget(scored(t), 5, [F.desc(F.round("score", 9)), F.col("b")]).select("scene_id", "a", "b", "score", F.array_join("rejection_flags", ",").alias("flags"), "status"))


@query("h14_budget_both")
def _(t):
    return rounded(pr.budget_both(scored(t), 5, [F.desc(F.round("score", 9)), F.col("a"), F.col("b")], lead=-F.round("score", 9)).select("scene_id", "a", "b", "score", "status"))


@query("h14_endpoint_budget")
def _(t):
    """Endpoint pairs and endpoint-edge proposals share each endpoint's budget."""
    kinds = pr.propose_edges(nodes(t), edges(t), 80.0).select("scene_id", "kind", "a", F.coalesce("b", "u").alias("b"), F.col("v").alias("far"), "distance")
    rows = kinds.withColumn("score", 1 - F.col("distance") / 80).withColumn("status", F.when(F.col("distance") > 75, "rejected_by_hard_gate").otherwise("proposed"))
    return rounded(pr.endpoint_budget(rows.drop("distance"), 2))


def scored(t):
    e = edges(t).select("scene_id", F.col("u").alias("a"), F.col("v").alias("b"), "length")
    e = e.withColumn("score", pr.heuristic_score({"distance": 1 - F.col("length") / 60, "angle": (F.col("a") % 10) / 10, "probability": (F.col("b") % 7) / 7, "graph": F.lit(0.5), "shape": F.lit(1.0)}))
    return pr.gate(e, [(F.col("length") > 55, "length"), (F.col("score") < 0.4, "score")])


@query("h15_component_pairs", COMP + """, b AS (SELECT scene_id, component, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM co JOIN pts USING (scene_id, id) GROUP BY 1, 2),
d AS (SELECT p.scene_id, p.component AS p, q.component AS q, sqrt(greatest(p.x0 - q.x1, q.x0 - p.x1, 0)**2 + greatest(p.y0 - q.y1, q.y0 - p.y1, 0)**2) AS d FROM b p JOIN b q ON p.scene_id = q.scene_id AND p.component <> q.component), k AS (SELECT *, row_number() OVER (PARTITION BY scene_id, p ORDER BY round(d, 9), q) AS k FROM d WHERE d <= 250)
SELECT scene_id, least(p, q) AS a, greatest(p, q) AS b, round(min(d), 6) AS distance FROM k WHERE k <= 10 GROUP BY 1, 2, 3""")
def _(t):
    return rounded(pr.component_pairs(nodes(t), edges(t), 250.0, 10))


@query("h17_corridor_cost", f"WITH {CELLS} SELECT x, y, round(1 + 8 * power(1 - value, 2) + CASE WHEN value < 0.45 THEN 20 ELSE 0 END, 6) AS cost FROM cells")
def _(t):
    return rounded(cells(t).select("x", "y", op.corridor_cost(F.col("value"), 8.0, 2.0, 20.0, 0.45).alias("cost")))


@query("h21_proposal_stats", W + """, s AS (SELECT u % 3 AS kind, CASE WHEN length > 40 THEN 'rejected' ELSE 'accepted' END AS status, length FROM g) SELECT kind, status, 'length' AS metric, count(*) AS n, round(min(length), 6) AS min, round(quantile_cont(length, 0.1), 6) AS p10, round(median(length), 6) AS median, round(quantile_cont(length, 0.9), 6) AS p90, round(max(length), 6) AS max, round(avg(length), 6) AS mean FROM s GROUP BY 1, 2""")
def _(t):
    e = edges(t).select((F.col("u") % 3).alias("kind"), F.when(F.col("length") > 40, "rejected").otherwise("accepted").alias("status"), "length")
    return rounded(pr.proposal_stats(e, "kind", ["length"]))


@query("h22_gap_candidates", COMP + """, n1 AS (SELECT bo.scene_id, bo.id, p.x, p.y, p.x - q.x AS dx, p.y - q.y AS dy, component FROM bo JOIN dg ON dg.scene_id = bo.scene_id AND dg.id = bo.id AND degree = 1 JOIN pts p ON p.scene_id = bo.scene_id AND p.id = bo.id JOIN pts q ON q.scene_id = bo.scene_id AND q.id = bo.other JOIN co ON co.scene_id = bo.scene_id AND co.id = bo.id),
d AS (SELECT a.scene_id, a.id AS a, b.id AS b, sqrt((a.x-b.x)**2 + (a.y-b.y)**2) AS distance, degrees(acos(greatest(-1, least(1, (a.dx*(b.x-a.x)+a.dy*(b.y-a.y)) / (sqrt(a.dx*a.dx+a.dy*a.dy) * sqrt((a.x-b.x)**2 + (a.y-b.y)**2)))))) AS turn_a, degrees(acos(greatest(-1, least(1, (b.dx*(a.x-b.x)+b.dy*(a.y-b.y)) / (sqrt(b.dx*b.dx+b.dy*b.dy) * sqrt((a.x-b.x)**2 + (a.y-b.y)**2)))))) AS turn_b FROM n1 a JOIN n1 b ON a.scene_id = b.scene_id AND a.id < b.id AND a.component <> b.component)
SELECT scene_id, a, b, round(distance, 5) AS distance, round(turn_a, 5) AS turn_a, round(turn_b, 5) AS turn_b FROM d WHERE distance BETWEEN 20 AND 120 AND turn_a <= 45 AND turn_b <= 45""")
def _(t):
    return rounded(pr.gap_candidates(nodes(t), edges(t)), 5)


@query("j6_diverse_routes")
def _(t):
    out = op.diverse_routes(nodes(t), edges(t))
    return rounded(out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ",")))
