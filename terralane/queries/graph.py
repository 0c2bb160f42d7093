"""Graph queries over points of embeddings (scene = label) with edges up to 60 long, and cells of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import graph as op
from .inputs import CELLS, GRAPH, POINTS, cells, edges, nodes, points, rounded

W = "WITH RECURSIVE " + GRAPH + """, bo AS (SELECT scene_id, u AS id, v AS other, length FROM g UNION ALL SELECT scene_id, v, u, length FROM g),
dg AS (SELECT p.scene_id, p.id, count(bo.other) AS degree FROM pts p LEFT JOIN bo USING (scene_id, id) GROUP BY 1, 2)"""
COMP = W + """, reach AS (SELECT scene_id, id, id AS r FROM pts UNION SELECT reach.scene_id, reach.id, bo.other FROM reach JOIN bo ON reach.scene_id = bo.scene_id AND reach.r = bo.id),
co AS (SELECT scene_id, id, min(r) AS component FROM reach GROUP BY 1, 2)"""
TABLE = COMP + """, ct AS (SELECT scene_id, component, count(*) AS nodes, count(*) FILTER (degree = 1) AS endpoints, coalesce(any_value(e.edges), 0) AS edges, coalesce(any_value(e.length), 0) AS length
 FROM co JOIN dg USING (scene_id, id) LEFT JOIN (SELECT g.scene_id, component, count(*) AS edges, sum(length) AS length FROM g JOIN co ON g.scene_id = co.scene_id AND g.u = co.id GROUP BY 1, 2) e USING (scene_id, component) GROUP BY 1, 2)"""
TRI = W + ", tr AS (SELECT x.scene_id, x.u AS a, x.v AS b, y.v AS c FROM g x JOIN g y ON x.scene_id = y.scene_id AND x.v = y.u JOIN g z ON z.scene_id = x.scene_id AND z.u = x.u AND z.v = y.v)"
DIR = W + """, an AS (SELECT bo.scene_id, bo.id, degrees(atan2(q.y - p.y, q.x - p.x)) AS raw FROM bo JOIN pts p ON p.scene_id = bo.scene_id AND p.id = bo.id JOIN pts q ON q.scene_id = bo.scene_id AND q.id = bo.other),
aw AS (SELECT scene_id, id, CASE WHEN raw < 0 THEN raw + 360 ELSE raw END AS a FROM an),
gp AS (SELECT scene_id, id, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY scene_id, id) + 360) - a AS gap FROM aw WINDOW w AS (PARTITION BY scene_id, id ORDER BY a)),
gr AS (SELECT scene_id, id, greatest(1, count(*) FILTER (gap > 30)) AS groups, max(gap) AS widest FROM gp GROUP BY 1, 2)"""
OBS = "ob AS (SELECT l_suppkey % 10 AS scene_id, l_suppkey AS source, l_partkey % 50 AS target, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS score FROM lineitem)"
AGG = OBS + ", ag AS (SELECT scene_id, source, target, avg(coalesce(score, -100.0)) AS score, count(*) AS observations FROM ob GROUP BY 1, 2, 3)"


def observations(t):
    return t.lineitem.select((F.col("l_suppkey") % 10).alias("scene_id"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_discount") * 10).alias("score"))


def some_edges(t):
    """The graph without the edges whose ends' sum divides by 5."""
    return edges(t).where("(u + v) % 5 <> 0")


SOME = "sg AS (SELECT * FROM g WHERE (u + v) % 5 <> 0)"


@query("f1_canonical_edges", """WITH r AS (SELECT l_suppkey % 4 AS scene_id, l_orderkey * 10 + l_linenumber AS ord, l_suppkey % 90 AS u, l_partkey % 100 AS v, l_discount AS score FROM lineitem),
k AS (SELECT scene_id, least(u, v) AS u, greatest(u, v) AS v, score, ord, row_number() OVER (PARTITION BY scene_id, least(u, v), greatest(u, v) ORDER BY score DESC, ord) AS k FROM r WHERE u <> v AND u < 80 AND v < 80) SELECT scene_id, u, v, score, ord FROM k WHERE k = 1""")
def _(t):
    return op.canonical_edges(*raw_graph(t), keep="max").select("scene_id", "u", "v", "score", "ord")


@query("f1_edge_audit", """WITH r AS (SELECT l_suppkey % 4 AS scene_id, l_suppkey % 90 AS u, l_partkey % 100 AS v FROM lineitem)
SELECT scene_id, count(*) AS given, count(*) FILTER (u = v) AS loops, count(*) FILTER (u <> v AND (u >= 80 OR v >= 80)) AS dangling, count(*) FILTER (u <> v AND u < 80 AND v < 80) - count(DISTINCT CASE WHEN u <> v AND u < 80 AND v < 80 THEN least(u, v) * 1000 + greatest(u, v) END) AS repeated,
count(DISTINCT CASE WHEN u <> v AND u < 80 AND v < 80 THEN least(u, v) * 1000 + greatest(u, v) END) AS kept FROM r GROUP BY 1""")
def _(t):
    return op.edge_audit(*raw_graph(t))


def raw_graph(t):
    e = t.lineitem.select((F.col("l_suppkey") % 4).alias("scene_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_suppkey") % 90).alias("u"), (F.col("l_partkey") % 100).alias("v"), F.col("l_discount").alias("score"))
    ids = e.select("scene_id", F.explode(F.array("u", "v")).alias("id")).where("id < 80").distinct()
    return ids, e


@query("f2_components", COMP + " SELECT * FROM co")
def _(t):
    return op.components(nodes(t), edges(t))


@query("f3_degrees", W + " SELECT scene_id, id, degree, degree = 1 AS endpoint, degree >= 3 AS junction FROM dg")
def _(t):
    return op.degrees(nodes(t), edges(t))


@query("f4_component_table", TABLE + ", m AS (SELECT scene_id, component, row_number() OVER (PARTITION BY scene_id ORDER BY nodes DESC, component) AS k FROM ct) SELECT scene_id, component, nodes, endpoints, edges, round(length, 6) AS length, k = 1 AS is_main FROM ct JOIN m USING (scene_id, component)")
def _(t):
    return rounded(op.component_table(nodes(t), edges(t)))


@query("f5_component_inventory", TABLE + """ SELECT scene_id, component, count(*) AS nodes, round(any_value(ct.length), 6) AS length, round(min(x), 6) AS x0, round(min(y), 6) AS y0, round(max(x), 6) AS x1, round(max(y), 6) AS y1, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
arg_min(id, x) AS "left", arg_max(id, x) AS "right", arg_min(id, y) AS top, arg_max(id, y) AS bottom FROM co JOIN pts USING (scene_id, id) JOIN ct USING (scene_id, component) GROUP BY 1, 2""")
def _(t):
    return rounded(op.component_inventory(nodes(t), edges(t)))


@query("f6_graph_stats", TABLE + """, a AS (SELECT scene_id, sum(nodes) AS nodes, sum(edges) AS edges, count(*) AS components, max(nodes) / sum(nodes) AS largest_ratio, sum(length) AS length, count(*) FILTER (nodes < 5) AS small_components, arg_max(edges, nodes * 1000000 - component) AS largest_edges FROM ct GROUP BY 1),
b AS (SELECT scene_id, count(*) FILTER (degree = 1) AS endpoints, count(*) FILTER (degree >= 3) AS junctions, count(*) FILTER (degree = 0) AS isolated, avg(degree) AS mean_degree, max(degree) AS max_degree FROM dg GROUP BY 1)
SELECT scene_id, CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, components, round(largest_ratio, 6) AS largest_ratio, round(length, 6) AS length, small_components, CAST(largest_edges AS BIGINT) AS largest_edges, endpoints, junctions, isolated, round(mean_degree, 6) AS mean_degree, max_degree, CAST(edges - nodes + components AS BIGINT) AS cycle_rank FROM a JOIN b USING (scene_id)""")
def _(t):
    return rounded(op.graph_stats(nodes(t), edges(t)))


@query("f6_degree_distribution", W + " SELECT scene_id, degree, count(*) AS n FROM dg GROUP BY 1, 2")
def _(t):
    return op.degree_distribution(nodes(t), edges(t))


@query("f7_score_summary", f"WITH {AGG} SELECT scene_id, round(avg(score), 6) AS score_mean, round(median(score), 6) AS score_median, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max FROM ag WHERE score > 0 GROUP BY 1")
def _(t):
    return rounded(op.score_summary(op.aggregate_scores(observations(t), 0.0).where("accepted")))


@query("f8_knn_within", f"WITH {POINTS}, d AS (SELECT a.scene_id, a.id AS source, b.id AS target, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS distance FROM pts a JOIN pts b ON a.scene_id = b.scene_id AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, source ORDER BY distance, target) AS rank FROM d WHERE distance <= 80) SELECT scene_id, source, target, round(distance, 6) AS distance, rank FROM r WHERE rank <= 16")
def _(t):
    return rounded(op.knn_within(points(t), 16, 80.0))


@query("f9_aggregate_scores", f"WITH {AGG} SELECT scene_id, source, target, round(score, 6) AS score, observations, score > 0.2 AS accepted FROM ag")
def _(t):
    return rounded(op.aggregate_scores(observations(t), 0.2))


@query("f10_undirected_mean", f"WITH {AGG} SELECT scene_id, least(source, target) AS u, greatest(source, target) AS v, round(avg(score), 6) AS score, count(*) AS directions FROM ag WHERE score > 0.2 AND source <> target GROUP BY 1, 2, 3")
def _(t):
    return rounded(op.undirected_mean(op.aggregate_scores(observations(t), 0.2), 0.2))


@query("f11_triangles", TRI + " SELECT * FROM tr")
def _(t):
    return op.triangles(edges(t))


@query("f11_node_triangles", TRI + " SELECT p.scene_id, p.id, count(tr.a) AS triangles FROM pts p LEFT JOIN tr ON p.scene_id = tr.scene_id AND p.id IN (tr.a, tr.b, tr.c) GROUP BY 1, 2")
def _(t):
    return op.node_triangles(nodes(t), edges(t))


@query("f12_crossings", W + """, e AS (SELECT g.scene_id, u, v, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM g JOIN pts p ON p.scene_id = g.scene_id AND p.id = u JOIN pts q ON q.scene_id = g.scene_id AND q.id = v)
SELECT a.scene_id, a.u, a.v, b.u AS u2, b.v AS v2 FROM e a JOIN e b ON a.scene_id = b.scene_id AND (a.u < b.u OR (a.u = b.u AND a.v < b.v)) AND a.u NOT IN (b.u, b.v) AND a.v NOT IN (b.u, b.v)
WHERE sign((b.x1-b.x0)*(a.y0-b.y0)-(b.y1-b.y0)*(a.x0-b.x0)) * sign((b.x1-b.x0)*(a.y1-b.y0)-(b.y1-b.y0)*(a.x1-b.x0)) < 0 AND sign((a.x1-a.x0)*(b.y0-a.y0)-(a.y1-a.y0)*(b.x0-a.x0)) * sign((a.x1-a.x0)*(b.y1-a.y0)-(a.y1-a.y0)*(b.x1-a.x0)) < 0""")
def _(t):
    return op.crossings(nodes(t), edges(t))


@query("f13_avg_clustering", TRI + ", k AS (SELECT p.scene_id, p.id, count(tr.a) AS n FROM pts p LEFT JOIN tr ON p.scene_id = tr.scene_id AND p.id IN (tr.a, tr.b, tr.c) GROUP BY 1, 2) SELECT scene_id, round(avg(CASE WHEN degree > 1 THEN 2 * n / (degree * (degree - 1)) ELSE 0 END), 6) AS avg_clustering FROM k JOIN dg USING (scene_id, id) GROUP BY 1")
def _(t):
    return rounded(op.avg_clustering(nodes(t), edges(t)))


@query("f14_bridges", COMP.replace("reach AS", "unused AS (SELECT 1), reach AS") + """, wo AS (SELECT g.scene_id, g.u AS a, g.v AS b, g.u AS pos FROM g UNION SELECT wo.scene_id, wo.a, wo.b, bo.other FROM wo JOIN bo ON wo.scene_id = bo.scene_id AND wo.pos = bo.id AND NOT (wo.pos = wo.a AND bo.other = wo.b) AND NOT (wo.pos = wo.b AND bo.other = wo.a))
SELECT scene_id, a AS u, b AS v, NOT bool_or(pos = b) AS bridge FROM wo GROUP BY 1, 2, 3""")
def _(t):
    return op.bridges(edges(t)).select("scene_id", "u", "v", "bridge")


@query("f15_node_roles", DIR + """ SELECT scene_id, id, CAST(coalesce(groups, 0) AS INT) AS groups, CASE WHEN groups IS NULL THEN 'isolated' WHEN groups = 1 THEN 'endpoint' WHEN groups = 2 AND widest <= 210 THEN 'corridor' WHEN groups >= 3 THEN 'junction' ELSE 'ambiguous' END AS role FROM pts LEFT JOIN gr USING (scene_id, id)""")
def _(t):
    return op.node_roles(nodes(t), edges(t))


@query("f16_role_metrics", DIR.replace("WITH RECURSIVE", "WITH RECURSIVE") + """, tr AS (SELECT x.scene_id, x.u AS a, x.v AS b, y.v AS c FROM g x JOIN g y ON x.scene_id = y.scene_id AND x.v = y.u JOIN g z ON z.scene_id = x.scene_id AND z.u = x.u AND z.v = y.v),
k AS (SELECT p.scene_id, p.id, count(tr.a) AS n FROM pts p LEFT JOIN tr ON p.scene_id = tr.scene_id AND p.id IN (tr.a, tr.b, tr.c) GROUP BY 1, 2),
ro AS (SELECT scene_id, id, CASE WHEN groups IS NULL THEN 'isolated' WHEN groups = 1 THEN 'endpoint' WHEN groups = 2 AND widest <= 210 THEN 'corridor' WHEN groups >= 3 THEN 'junction' ELSE 'ambiguous' END AS role FROM pts LEFT JOIN gr USING (scene_id, id))
SELECT scene_id, quantile_cont(degree, 0.5) AS degree_p50, round(quantile_cont(degree, 0.9), 6) AS degree_p90, count(*) FILTER (role = 'endpoint') AS endpoint_nodes, count(*) FILTER (role = 'corridor') AS corridor_nodes, count(*) FILTER (role = 'junction') AS junction_nodes, count(*) FILTER (role = 'ambiguous') AS ambiguous_nodes, count(*) FILTER (role = 'isolated') AS isolated_nodes, round(avg(n), 6) AS triangles_per_node
FROM ro JOIN dg USING (scene_id, id) JOIN k USING (scene_id, id) GROUP BY 1""")
def _(t):
    return rounded(op.role_metrics(nodes(t), edges(t)))


@query("f17_candidate_metrics", TRI + """, ch AS (SELECT scene_id, a AS u, b AS v FROM tr UNION SELECT scene_id, b, c FROM tr UNION SELECT scene_id, a, c FROM tr), d AS (SELECT scene_id, avg(degree) AS m, quantile_cont(degree, 0.5) AS p50, quantile_cont(degree, 0.9) AS p90, max(degree) AS mx FROM dg GROUP BY 1)
SELECT scene_id, round(m, 6) AS degree_mean, p50 AS degree_p50, round(p90, 6) AS degree_p90, mx AS degree_max, e.n AS edges, coalesce(c.n, 0) AS chords, round(coalesce(c.n, 0) / e.n, 6) AS chord_fraction FROM d JOIN (SELECT scene_id, count(*) AS n FROM g GROUP BY 1) e USING (scene_id) LEFT JOIN (SELECT scene_id, count(*) AS n FROM ch GROUP BY 1) c USING (scene_id)""")
def _(t):
    return rounded(op.candidate_metrics(nodes(t), edges(t)))


@query("f18_edge_retention", W + f", {SOME} SELECT g.scene_id, count(*) AS reference, count(sg.u) AS kept, round(count(sg.u) / count(*), 6) AS retention FROM g LEFT JOIN sg USING (scene_id, u, v) GROUP BY 1")
def _(t):
    return rounded(op.edge_retention(edges(t), some_edges(t)))


@query("f19_group_retention", DIR + """, aw2 AS (SELECT bo.scene_id, bo.id, degrees(atan2(q.y - p.y, q.x - p.x)) AS raw FROM bo JOIN pts p ON p.scene_id = bo.scene_id AND p.id = bo.id JOIN pts q ON q.scene_id = bo.scene_id AND q.id = bo.other WHERE (bo.id + bo.other) % 5 <> 0),
a2 AS (SELECT scene_id, id, CASE WHEN raw < 0 THEN raw + 360 ELSE raw END AS a FROM aw2), g2 AS (SELECT scene_id, id, coalesce(lead(a) OVER w, min(a) OVER (PARTITION BY scene_id, id) + 360) - a AS gap FROM a2 WINDOW w AS (PARTITION BY scene_id, id ORDER BY a)),
r2 AS (SELECT scene_id, id, greatest(1, count(*) FILTER (gap > 30)) AS after FROM g2 GROUP BY 1, 2)
SELECT scene_id, count(*) AS nodes, round(avg(least(1.0, coalesce(after, 0) / groups)), 6) AS retention FROM gr LEFT JOIN r2 USING (scene_id, id) WHERE groups >= 3 GROUP BY 1""")
def _(t):
    return rounded(op.group_retention(nodes(t), edges(t), some_edges(t)))


TWO = COMP + f""", {SOME}, bs AS (SELECT scene_id, u AS id, v AS other FROM sg UNION ALL SELECT scene_id, v, u FROM sg), reach2 AS (SELECT scene_id, id, id AS r FROM pts UNION SELECT reach2.scene_id, reach2.id, bs.other FROM reach2 JOIN bs ON reach2.scene_id = bs.scene_id AND reach2.r = bs.id), c2 AS (SELECT scene_id, id, min(r) AS cb FROM reach2 GROUP BY 1, 2)"""


@query("f20_connectivity_diff", TWO + """, k AS (SELECT scene_id, id, component AS ca, cb FROM co JOIN c2 USING (scene_id, id) JOIN dg USING (scene_id, id) WHERE degree = 1),
a AS (SELECT scene_id, count(*) FILTER (n > 1) AS split, CAST(sum(m) AS BIGINT) AS endpoints FROM (SELECT scene_id, ca, count(DISTINCT cb) AS n, count(*) AS m FROM k GROUP BY 1, 2) GROUP BY 1), b AS (SELECT scene_id, count(*) FILTER (n > 1) AS joined FROM (SELECT scene_id, cb, count(DISTINCT ca) AS n FROM k GROUP BY 1, 2) GROUP BY 1)
SELECT scene_id, split, endpoints, joined, split = 0 AND joined = 0 AS same FROM a JOIN b USING (scene_id)""")
def _(t):
    return op.connectivity_diff(nodes(t), edges(t), some_edges(t))


@query("f21_preservation", W + f", {SOME}, d2 AS (SELECT p.scene_id, p.id, count(b.o) AS after FROM pts p LEFT JOIN (SELECT scene_id, u AS id, v AS o FROM sg UNION ALL SELECT scene_id, v, u FROM sg) b USING (scene_id, id) GROUP BY 1, 2) SELECT scene_id, id, CASE WHEN degree = 1 THEN 'endpoint' ELSE 'junction' END AS kind, degree AS before, after, CASE WHEN degree = 1 THEN after = 1 ELSE after >= 3 END AS kept FROM dg JOIN d2 USING (scene_id, id) WHERE degree = 1 OR degree >= 3")
def _(t):
    return op.preservation(nodes(t), edges(t), some_edges(t))


@query("f22_nn_profile", W + ", n AS (SELECT scene_id, id, min(length) AS d FROM bo GROUP BY 1, 2) SELECT p.scene_id, count(*) AS points, count(n.d) AS with_neighbour, round(avg(n.d), 6) AS mean, round(quantile_cont(n.d, 0.1), 6) AS p10, round(quantile_cont(n.d, 0.5), 6) AS p50, round(quantile_cont(n.d, 0.9), 6) AS p90 FROM pts p LEFT JOIN n USING (scene_id, id) GROUP BY 1")
def _(t):
    return rounded(op.nn_profile(points(t), 60.0))


@query("f23_radius_clusters", COMP.replace("<= 60)", "<= 50)") + ", k AS (SELECT scene_id, component, count(*) AS n FROM co GROUP BY 1, 2) SELECT scene_id, count(*) AS clusters, max(n) AS largest, round(avg(n), 6) AS mean_size FROM k GROUP BY 1")
def _(t):
    return rounded(op.radius_clusters(points(t), 50.0))


@query("f24_length_profile", W + ", k AS (SELECT scene_id, count(*) AS nodes FROM pts GROUP BY 1) SELECT scene_id, any_value(nodes) AS nodes, count(*) AS edges, round(quantile_cont(length, 0.1), 6) AS p10, round(quantile_cont(length, 0.5), 6) AS p50, round(quantile_cont(length, 0.9), 6) AS p90, count(*) FILTER (length < 30) AS under_30, count(*) FILTER (length < 50) AS under_50, count(*) FILTER (length < 100) AS under_100, round(count(*) / any_value(nodes), 6) AS per_node FROM k JOIN g USING (scene_id) GROUP BY 1")
def _(t):
    return rounded(op.length_profile(nodes(t), edges(t)))


LINES = CELLS + """, li AS (SELECT s_suppkey AS u, s_suppkey + 1000000 AS v, s_nationkey * 2.5 AS x0, s_suppkey % 60 + 0.25 AS y0, 63 - s_nationkey * 2.0 AS x1, (s_suppkey * 7) % 63 + 0.0 AS y1 FROM supplier),
n AS (SELECT *, CAST(greatest(15, ceil(sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)))) AS INT) AS n FROM li), s AS (SELECT u, v, n, unnest(range(0, n + 1)) AS k, x0, y0, x1, y1 FROM n),
sv AS (SELECT u, v, k, n, coalesce(value, 0) AS value FROM s LEFT JOIN cells ON cells.x = CAST(round_even(x0 + (x1 - x0) * k / n, 0) AS BIGINT) AND cells.y = CAST(round_even(y0 + (y1 - y0) * k / n, 0) AS BIGINT)),
ru AS (SELECT u, v, run, count(*) AS c FROM (SELECT *, sum(CASE WHEN value < 0.4 THEN 0 ELSE 1 END) OVER (PARTITION BY u, v ORDER BY k) AS run FROM sv) WHERE value < 0.4 GROUP BY 1, 2, 3),
su AS (SELECT u, v, count(*) AS samples, avg(value) AS mean, median(value) AS median, min(value) AS min, quantile_cont(value, 0.1) AS p10, avg(CASE WHEN value < 0.4 THEN 0 ELSE 1 END) AS above, coalesce((SELECT max(c) FROM ru WHERE ru.u = sv.u AND ru.v = sv.v), 0) / count(*) AS longest_low FROM sv GROUP BY 1, 2)"""


def lines(t):
    return t.supplier.select(F.lit(0).alias("scene_id"), F.col("s_suppkey").alias("u"), (F.col("s_suppkey") + 1000000).alias("v"), (F.col("s_nationkey") * 2.5).alias("x0"), (F.col("s_suppkey") % 60 + 0.25).alias("y0"), (63 - F.col("s_nationkey") * 2.0).alias("x1"), ((F.col("s_suppkey") * 7) % 63 + 0.0).alias("y1"))


def field(t):
    return cells(t).withColumn("scene_id", F.lit(0))


@query("f25_line_support", f"WITH {LINES} SELECT u, v, samples, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(p10, 6) AS p10, round(above, 6) AS above, round(longest_low, 6) AS longest_low FROM su")
def _(t):
    return rounded(op.line_support(lines(t), field(t), 0.4).drop("scene_id"))


@query("f26_low_support", f"WITH {LINES} SELECT 0 AS scene_id, count(*) AS edges, count(*) FILTER (u % 3 = 0) AS accepted, round(avg(CASE WHEN u % 3 = 0 THEN CASE WHEN mean < 0.5 THEN 1 ELSE 0 END END), 6) AS low_share FROM su")
def _(t):
    return rounded(op.low_support(op.line_support(lines(t), field(t), 0.4), lines(t).withColumn("accepted", F.col("u") % 3 == 0), 0.5))


@query("f27_axis_agreement", f"""WITH {POINTS}, q AS (SELECT scene_id, id, x, y, (id * 37) % 180 AS axis, (id % 10) / 10 AS an FROM pts), d AS (SELECT a.scene_id, abs(a.axis - b.axis) % 180 AS d FROM q a JOIN q b ON a.scene_id = b.scene_id AND a.id < b.id AND a.an >= 0.5 AND b.an >= 0.5 AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 100)
SELECT scene_id, count(*) AS pairs, median(least(d, 180 - d)) AS median FROM d GROUP BY 1""")
def _(t):
    return op.axis_agreement(points(t).withColumn("axis", (F.col("id") * 37) % 180).withColumn("anisotropy", (F.col("id") % 10) / 10))


@query("f28_score_points", f"WITH {CELLS}, p AS (SELECT s_suppkey AS id, s_acctbal / 200 AS x, s_nationkey * 2 AS y FROM supplier) SELECT id, round(value, 6) AS keypoint, round(greatest(value, 1 - value), 6) AS score FROM p JOIN cells c ON c.x = round_even(p.x, 0) AND c.y = p.y WHERE value > 0.45")
def _(t):
    p = t.supplier.select(F.lit(0).alias("scene_id"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 200).alias("x"), (F.col("s_nationkey") * 2).alias("y"))
    c = field(t).withColumn("keypoint", F.col("value")).withColumn("road", 1 - F.col("value"))
    return rounded(op.score_points(p, c, 0.45).select("id", "keypoint", "score"))
