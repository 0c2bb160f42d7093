"""Source mining and connection proposals over scene graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geom
from ..functions.quantiles import quantiles
from ..functions.spatial import near_points, near_segments
from ..plans.scratch import few, free, stored
from .graph import SCENE, component_inventory, component_table, components, degrees, with_ends

# Shares of the five sub-scores.
SCORE_SHARES = {"distance": 0.15, "angle": 0.2, "probability": 0.4, "graph": 0.15, "shape": 0.1}


def mine_disconnected(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_length: float) -> DataFrame:
    """Components other than the main one, within limits on nodes and length."""
    return component_table(nodes, edges).where(~F.col("is_main") & (F.col("nodes") <= max_nodes) & (F.col("length") <= max_length))


def source_inventory(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(scene, component, members, ends): the sorted nodes and endpoints of each source component."""
    m = components(nodes, edges).join(sources.select(SCENE, "component"), [SCENE, "component"]).join(degrees(nodes, edges).select(SCENE, "id", "endpoint"), [SCENE, "id"])
    return m.groupBy(SCENE, "component").agg(F.array_sort(F.collect_list("id")).alias("members"), F.array_sort(F.collect_list(F.when(F.col("endpoint"), F.col("id")))).alias("ends"))


def propose_v1(sources: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float, k: int) -> DataFrame:
    """Up to k proposals of each source endpoint (scene, source, id): to the nearest place of edges and endpoints of other components.

    Proposals to one target are kept once per place (3 decimals); nearest first, then by kind and target.
    """
    comp = components(nodes, edges)
    at = sources.join(nodes, [SCENE, "id"]).join(comp.withColumnRenamed("component", "own"), [SCENE, "id"])
    e = with_ends(nodes, edges.select(SCENE, "u", "v")).join(comp.select(SCENE, F.col("id").alias("u"), F.col("component").alias("other")), [SCENE, "u"])
    hit = near_segments(at.select(SCENE, "source", "id", "own", "x", "y"), e, radius, SCENE).where("own <> other")
    px, py = F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0")), F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0"))
    to_edge = hit.select(SCENE, "source", "id", F.lit("edge").alias("kind"), "u", "v", px.alias("px"), py.alias("py"), "distance")
    ends = nodes.join(degrees(nodes, edges).where("endpoint").select(SCENE, "id"), [SCENE, "id"]).join(comp, [SCENE, "id"])
    near = near_points(at, ends, radius, SCENE).join(at.select(SCENE, F.col("id").alias("id_a"), "source", "own"), [SCENE, "id_a"])
    near = near.join(ends.select(SCENE, F.col("id").alias("id_b"), "component", F.col("x").alias("px"), F.col("y").alias("py")), [SCENE, "id_b"]).where("own <> component")
    to_end = near.select(SCENE, "source", F.col("id_a").alias("id"), F.lit("endpoint").alias("kind"), F.col("id_b").alias("u"), F.col("id_b").alias("v"), "px", "py", "distance")
    rows = to_edge.unionByName(to_end).withColumn("__x", F.round("px", 3)).withColumn("__y", F.round("py", 3))
    w = Window.partitionBy(SCENE, "source", "id", "__x", "__y").orderBy("kind", "u", "v")
    rows = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1")
    rank = F.row_number().over(Window.partitionBy(SCENE, "source", "id").orderBy(F.round("distance", 9), "kind", "u", "v"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.drop("__x", "__y", "__k").withColumn("proposal_id", F.format_string("s%d_e%d_%03d", "source", "id", "rank"))


def propose_ends(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(scene, a, b, distance): pairs of endpoints within the radius that no edge joins."""
    ends = nodes.join(degrees(nodes, edges).where("endpoint").select(SCENE, "id"), [SCENE, "id"])
    pairs = near_points(ends, ends, radius, SCENE).where("id_a < id_b").select(SCENE, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance")
    return pairs.join(edges.select(SCENE, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), [SCENE, "a", "b"], "left_anti")


def propose_junctions(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(scene, a, b, distance, sector): endpoint a to junction b, with the least angle between the way there and b's edges."""
    from .graph import direction_table

    d = degrees(nodes, edges)
    pick = lambda c: nodes.join(d.where(c).select(SCENE, "id"), [SCENE, "id"])
    near = near_points(pick("endpoint"), pick("junction"), radius, SCENE)
    near = near.join(edges.select(SCENE, F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).join(near.select(SCENE, "id_a", "id_b", F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi")), [SCENE, "lo", "hi"]).select(SCENE, "id_a", "id_b"), [SCENE, "id_a", "id_b"], "left_anti")
    p = lambda i: nodes.select(SCENE, F.col("id").alias(f"id_{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    rows = near.join(p("a"), [SCENE, "id_a"]).join(p("b"), [SCENE, "id_b"]).join(direction_table(nodes, edges).withColumnRenamed("id", "id_b"), [SCENE, "id_b"])
    way = F.degrees(F.atan2(F.col("ya") - F.col("yb"), F.col("xa") - F.col("xb")))
    gap = lambda a: F.least(F.pmod(F.abs(a - way), F.lit(360.0)), 360.0 - F.pmod(F.abs(a - way), F.lit(360.0)))
    return rows.select(SCENE, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance", F.array_min(F.transform("angles", gap)).alias("sector"))


def dedup(proposals: DataFrame, kind: str, a: str, b: str, order: Sequence[Column]) -> DataFrame:
    """One proposal per kind and unordered pair, with the number of those that it stands for."""
    key = [SCENE, F.col(kind), F.least(a, b), F.greatest(a, b)]
    rows = proposals.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("duplicates", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return rows.where("k = 1").drop("k")


def heuristic_score(parts: dict[str, Column]) -> Column:
    """The weighted sum of the five sub-scores (each 0 to 1)."""
    total = F.lit(0.0)
    for name, share in SCORE_SHARES.items():
        total = total + share * parts[name]
    return total


def gate(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Add rejection_flags and status; rejected rows stay."""
    flags = F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))
    return rows.withColumn("rejection_flags", flags).withColumn("status", F.when(F.size("rejection_flags") == 0, "accepted").otherwise("rejected"))


def budget(rows: DataFrame, n: int, order: Sequence[Column], end: str = "a") -> DataFrame:
    """The n first rows of each single-ended endpoint."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(SCENE, end).orderBy(*order))).where(F.col("k") <= n).drop("k")


#: Rows that budget_both takes into its rounds at a time, about.
BUDGET_ROWS = 1 << 21


def budget_both(rows: DataFrame, n: int, order: Sequence[Column], lead: Column | None = None, most: int = BUDGET_ROWS) -> DataFrame:
    """The rows (scene, a, b, status) that a greedy pass by `order` takes when each endpoint, as a or b, has room for n rows.

    Rejected rows stay and take no room.

    Each round takes the rows that are among the first of both their ends as far as these have room; those with a full
    end drop out. The first row of all is always taken, so the rounds end. `order` must leave no ties.

    lead: the number by which `order` sorts first, ascending. With it, about `most` rows at a time are taken in that order, of those whose ends still have room,
    so rows that can't be taken any more are neither shuffled nor written.
    """
    rest, used, out, low = rows.where("status <> 'rejected'"), None, rows.where("status = 'rejected'"), None
    if lead is None:
        return _both(rest, n, order, None).select(*rows.columns).unionByName(out)
    rest = rest.withColumn("__lead", lead)
    while True:
        left = rest if low is None else rest.where(F.col("__lead") > low)
        if used is not None:
            full = few(used.where(F.col("used") >= n))
            for c in "ab":
                left = left.join(full.select(SCENE, F.col("end").alias(c)), [SCENE, c], "left_anti")
        count = left.count()
        if count > most:
            low = left.select(F.percentile_approx("__lead", F.lit(most / count), F.lit(10_000))).first()[0]
            left = left.where(F.col("__lead") <= low)
        now = stored(_both(left.drop("__lead"), n, order, used).select(*rows.columns), "taken")
        out = now.unionByName(out)
        if count <= most:
            return out
        more = now.select(SCENE, F.explode(F.array_distinct(F.array("a", "b"))).alias("end"), F.lit(1).cast("long").alias("used"))
        more = more if used is None else more.unionByName(used)
        used = stored(more.groupBy(SCENE, "end").agg(F.sum("used").alias("used")), "used")


def _both(rows: DataFrame, n: int, order: Sequence[Column], used: DataFrame | None) -> DataFrame:
    """The rows that budget_both takes, none of them rejected, where ends (scene, end, used) have taken some before."""
    number = F.row_number().over(Window.partitionBy(SCENE).orderBy(*order))
    every = stored(rows.withColumn("__k", number), "budget")
    ends = every.select(SCENE, "__k", F.explode(F.array_distinct(F.array("a", "b"))).alias("end"), F.lit(False).alias("taken"))
    ends = ends.withColumn("used", F.lit(0).cast("long")) if used is None else ends.join(few(used), [SCENE, "end"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    ends = stored(ends.select(SCENE, "__k", "end", "taken", "used"), "ends")
    w = Window.partitionBy(SCENE, "end")
    while not ends.where("not taken").isEmpty():
        room = ends.withColumn("room", n - F.col("used") - F.count_if("taken").over(w))
        rank = F.row_number().over(Window.partitionBy(SCENE, "end", "taken").orderBy("__k"))
        row = Window.partitionBy(SCENE, "__k")
        step = room.withColumn("rank", rank).withColumn("full", F.max(F.col("room") <= 0).over(row)).withColumn("first", F.min(F.col("rank") <= F.col("room")).over(row))
        before, ends = ends, stored(step.where("taken or not full").select(SCENE, "__k", "end", (F.col("taken") | F.col("first")).alias("taken"), "used"), "ends")
        free(before)
    return every.join(ends.select(SCENE, "__k").distinct(), [SCENE, "__k"]).select(*rows.columns)


def endpoint_budget(rows: DataFrame, n: int = 5, open_status: str = "proposed") -> DataFrame:
    """Rows (scene, kind, a, b, score, status, ...) with budget_excluded: what one pass by score has no room for.

    Best score first, then by kind, a, b and the other columns in order, each endpoint has room for n rows of status open_status, of all kinds together: a counts for every kind, b for endpoint_endpoint
    only. Rows of another status are never excluded and take no room. All rows stay; rows that agree in all columns share one decision.

    Each round takes the rows that are among the first of their ends as far as these have room, and excludes those with a full end; only rows of one endpoint are ranked
    together.
    """
    rest = [c for c in rows.columns if c not in (SCENE, "kind", "a", "b", "score")]
    key = F.struct((-F.round("score", 9)).alias("s"), "kind", "a", "b", *rest).alias("__key")
    every = stored(rows.withColumn("__key", key), "budget")
    both = F.when(F.col("kind") == "endpoint_endpoint", F.array_distinct(F.array("a", "b"))).otherwise(F.array("a"))
    ends = stored(every.where(F.col("status") == open_status).select(SCENE, "__key", F.explode(both).alias("end"), F.lit(False).alias("taken")).distinct(), "ends")
    while not ends.where("not taken").isEmpty():
        room = n - F.count_if("taken").over(Window.partitionBy(SCENE, "end"))
        rank = F.row_number().over(Window.partitionBy(SCENE, "end", "taken").orderBy("__key"))
        row = Window.partitionBy(SCENE, "__key")
        step = ends.withColumn("room", room).withColumn("rank", rank).withColumn("full", F.max(F.col("room") <= 0).over(row)).withColumn("first", F.min(F.col("rank") <= F.col("room")).over(row))
        before, ends = ends, stored(step.where("taken or not full").select(SCENE, "__key", "end", (F.col("taken") | F.col("first")).alias("taken")), "ends")
        free(before)
    taken = ends.select(SCENE, F.col("__key").alias("k"), F.lit(True).alias("__t")).distinct()
    out = every.join(taken, (every[SCENE] == taken[SCENE]) & every["__key"].eqNullSafe(taken["k"]), "left")
    return out.select(*(every[c] for c in rows.columns), ((F.col("status") == open_status) & F.col("__t").isNull()).alias("budget_excluded"))


def component_pairs(nodes: DataFrame, edges: DataFrame, radius: float, k: int) -> DataFrame:
    """(scene, a, b, distance): components whose boxes lie within the radius, each with its k nearest ones, as unordered pairs.

    Boxes are dealt to square cells that they, widened by the radius, touch.
    """
    from ..functions.spatial import box_cells

    inv = component_inventory(nodes, edges).select(SCENE, "component", "x0", "y0", "x1", "y1").withColumn("c", box_cells("x0", "y0", "x1", "y1", radius, radius / 2))
    a, b = inv.alias("a"), inv.alias("b")
    d = geom.box_distance(*(F.col(f"{s}.{c}") for s in "ab" for c in ("x0", "y0", "x1", "y1")))
    near = a.join(b, (F.col(f"a.{SCENE}") == F.col(f"b.{SCENE}")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.component") != F.col("b.component")))
    near = near.select(F.col(f"a.{SCENE}").alias(SCENE), F.col("a.component").alias("p"), F.col("b.component").alias("q"), d.alias("distance")).where(F.col("distance") <= radius).distinct()
    rank = F.row_number().over(Window.partitionBy(SCENE, "p").orderBy(F.round("distance", 9), "q"))
    near = near.withColumn("k", rank).where(F.col("k") <= k)
    return near.select(SCENE, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance").groupBy(SCENE, "a", "b").agg(F.min("distance").alias("distance"))


def proposal_stats(rows: DataFrame, kind: str, values: Sequence[str]) -> DataFrame:
    """(kind, status, metric, n, min, p10, median, p90, max, mean)."""
    long = rows.unpivot([kind, "status"], [F.col(v).cast("double").alias(v) for v in values], "metric", "v")
    by = [kind, "status", "metric"]
    q = quantiles(long, by, "v", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    out = long.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    # a row or two for each kind on both sides; kinds may be null
    q = q.select(F.struct(*by).alias("__g"), "p10", "median", "p90")
    return out.withColumn("__g", F.struct(*by)).join(q, "__g", "left").select(*by, "n", "min", "p10", "median", "p90", "max", "mean")


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("rejection_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def gap_candidates(nodes: DataFrame, edges: DataFrame, low: float = 20.0, high: float = 120.0, angle: float = 45.0) -> DataFrame:
    """(scene, a, b, distance, turn_a, turn_b): endpoints of different components whose outward directions face each other.

    The outward direction of an endpoint is away from its one neighbour.
    """
    from .graph import both_ends

    d = degrees(nodes, edges).where("endpoint").select(SCENE, "id")
    p = nodes.select(SCENE, "id", "x", "y")
    far = both_ends(edges.select(SCENE, "u", "v")).join(d, [SCENE, "id"]).join(p.withColumnsRenamed({"id": "other", "x": "ox", "y": "oy"}), [SCENE, "other"])
    ends = far.join(p, [SCENE, "id"]).join(components(nodes, edges), [SCENE, "id"]).select(SCENE, "id", "x", "y", (F.col("x") - F.col("ox")).alias("dx"), (F.col("y") - F.col("oy")).alias("dy"), "component")
    pairs = near_points(ends, ends, high, SCENE).where((F.col("id_a") < F.col("id_b")) & (F.col("distance") >= low))
    side = lambda s: ends.select(SCENE, *(F.col(c).alias(f"{c}_{s}") for c in ("id", "x", "y", "dx", "dy", "component")))
    rows = pairs.join(side("a"), [SCENE, "id_a"]).join(side("b"), [SCENE, "id_b"]).where("component_a <> component_b")
    vx, vy = F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")
    rows = rows.withColumn("turn_a", geom.directed_angle("dx_a", "dy_a", vx, vy)).withColumn("turn_b", geom.directed_angle("dx_b", "dy_b", -vx, -vy))
    return rows.where((F.col("turn_a") <= angle) & (F.col("turn_b") <= angle)).select(SCENE, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "distance", "turn_a", "turn_b")


def endpoint_tangents(nodes: DataFrame, edges: DataFrame, look_back: float = 30.0) -> DataFrame:
    """(scene, id, tx, ty, points): unit vector out of the graph at each endpoint, the main direction of the points up to look_back along its chain."""
    from .clean import chain_ends, chains
    from .routing import route_geometry, straight_routes

    ends = chain_ends(chains(nodes, edges), nodes, edges)
    first, last = F.col("path")[0], F.element_at("path", -1)
    ways = ends.where("d_first = 1").select(SCENE, first.alias("id"), "path").unionByName(ends.where("d_last = 1").select(SCENE, last.alias("id"), F.reverse("path").alias("path")))
    line = route_geometry(ways, nodes, edges) if "polyline" in edges.columns else straight_routes(ways, nodes)
    line = line.withColumn("line", geom.sliced(F.col("polyline"), F.lit(0.0), F.least(F.lit(float(look_back)), F.col("length"))))
    n = F.size("line")
    mean = lambda f: F.aggregate("line", F.lit(0.0), lambda acc, p: acc + f(p)) / n
    line = line.withColumn("mx", mean(lambda p: p["x"])).withColumn("my", mean(lambda p: p["y"]))
    dx, dy = lambda p: p["x"] - F.col("mx"), lambda p: p["y"] - F.col("my")
    angle = geom.principal_angle(mean(lambda p: dx(p) * dx(p)), mean(lambda p: dx(p) * dy(p)), mean(lambda p: dy(p) * dy(p)))
    line = line.withColumn("a", angle)
    start, stop = F.get("line", F.lit(0)), F.element_at("line", -1)
    out = F.when(F.cos("a") * (start["x"] - stop["x"]) + F.sin("a") * (start["y"] - stop["y"]) < 0, -1.0).otherwise(1.0)
    return line.select(SCENE, "id", (F.cos("a") * out).alias("tx"), (F.sin("a") * out).alias("ty"), n.alias("points"))


def propose_edges(nodes: DataFrame, edges: DataFrame, radius: float = 60.0, snap: float = 8.0, ends_radius: float = 80.0) -> DataFrame:
    """(scene, kind, a, b, u, v, t, distance, angle, pattern): endpoint a to the nearest place of each edge (u, v) within the radius, its own left out.

    A place within `snap` of the edge's nearer end (u where both are) goes to that node b: endpoint_junction where it has three edges or more,
    endpoint_endpoint (a < b) where it has one and lies within ends_radius, else nothing; a node of two edges is a place like any other.
    For endpoint_edge, pattern tells how the connector meets the edge: near_parallel under 25 degrees, near_perpendicular over 65, else
    oblique. Connectors without length go, as do repeated ones to one node.
    """
    d = few(stored(degrees(nodes, edges), "degrees"))
    ends = nodes.join(d.where("endpoint").select(SCENE, "id"), [SCENE, "id"]).select(SCENE, "id", "x", "y")
    rows = near_segments(ends, with_ends(nodes, edges.select(SCENE, "u", "v")), radius, SCENE).where("id <> u and id <> v")
    rows = rows.withColumn("px", F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).withColumn("py", F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0")))
    rows = rows.withColumn("du", geom.distance("px", "py", "x0", "y0")).withColumn("dv", geom.distance("px", "py", "x1", "y1"))
    at_u = F.col("du") <= F.col("dv")
    rows = rows.withColumn("near", F.when(at_u, F.col("u")).otherwise(F.col("v"))).withColumn("to_near", F.when(at_u, geom.distance("x", "y", "x0", "y0")).otherwise(geom.distance("x", "y", "x1", "y1")))
    rows = rows.join(d.select(SCENE, F.col("id").alias("near"), F.col("degree").alias("near_degree")), [SCENE, "near"])
    snapped = (F.least("du", "dv") <= snap) & (F.col("near_degree") != 2)
    kind = F.when(~snapped, "endpoint_edge").when(F.col("near_degree") >= 3, "endpoint_junction").when(F.col("to_near") <= ends_radius, "endpoint_endpoint")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    pair = F.col("kind") == "endpoint_endpoint"
    to_node = rows.where("kind <> 'endpoint_edge' and to_near >= 1e-4").select(SCENE, "kind", F.when(pair, F.least("id", "near")).otherwise(F.col("id")).alias("a"), F.when(pair, F.greatest("id", "near")).otherwise(F.col("near")).alias("b"), "to_near")
    to_node = to_node.groupBy(SCENE, "kind", "a", "b").agg(F.min("to_near").alias("distance"))
    none = lambda k, *names: [F.lit(None).cast(k).alias(c) for c in names]
    to_node = to_node.select(SCENE, "kind", "a", "b", *none("long", "u", "v"), *none("double", "t"), "distance", *none("double", "angle"), *none("string", "pattern"))
    to_edge = rows.where("kind = 'endpoint_edge' and distance >= 1e-4").withColumn("angle", geom.axis_angle(F.col("px") - F.col("x"), F.col("py") - F.col("y"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    pattern = F.when(F.col("angle") < 25, "near_parallel").when(F.col("angle") > 65, "near_perpendicular").otherwise("oblique")
    return to_edge.select(SCENE, "kind", F.col("id").alias("a"), *none("long", "b"), "u", "v", "t", "distance", "angle", pattern.alias("pattern")).unionByName(to_node)


def path_probability(paths: DataFrame, cells: DataFrame, low: float = 0.2) -> DataFrame:
    """(scene, a, b, mean, median, p10, p25, minimum, maximum, std, below_02, below_03, longest_low, samples, evidence) of straight paths (scene, a, b, x0, y0, x1, y1).

    Values are bilinear, at places at most 1 apart, 16 at least; a missing cell counts as 0. Without any cell of the scene: 0.5 for the values, 0 for the rest.
    """
    from .raster import bilinear

    n = F.greatest(F.lit(15), F.ceil(geom.distance("x0", "y0", "x1", "y1"))).cast("int")
    s = paths.select(SCENE, "a", "b", "x0", "y0", "x1", "y1").withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c: (F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * F.col("k") / F.col("n")).alias(c)
    s = s.join(cells.select(SCENE).distinct(), SCENE, "left_semi").select(SCENE, F.struct("a", "b", "k").alias("id"), at("x"), at("y"))
    v = s.select(SCENE, "id").join(bilinear(s, cells), [SCENE, "id"], "left").select(SCENE, "id.a", "id.b", "id.k", F.round(F.coalesce("value", F.lit(0.0)), 9).alias("p"))
    q = lambda x: F.percentile("p", F.lit(x))
    below = lambda x: F.avg((F.col("p") < x).cast("int"))
    out = v.groupBy(SCENE, "a", "b").agg(
        F.avg("p").alias("mean"), q(0.5).alias("median"), q(0.1).alias("p10"), q(0.25).alias("p25"), F.min("p").alias("minimum"), F.max("p").alias("maximum"), F.stddev_pop("p").alias("std"),
        below(0.2).alias("below_02"), below(0.3).alias("below_03"), F.count(F.lit(1)).alias("samples"), F.array_sort(F.collect_list(F.struct("k", (F.col("p") < low).alias("low")))).alias("__low"),
    )
    out = out.withColumn("longest_low", geom.longest_run(F.col("__low")["low"]) / F.col("samples")).withColumn("evidence", F.lit(True)).drop("__low")
    out = paths.select(SCENE, "a", "b").join(out, [SCENE, "a", "b"], "left")
    return out.fillna({c: 0.5 for c in ("mean", "median", "p10", "p25", "minimum", "maximum")} | {c: 0.0 for c in ("std", "below_02", "below_03", "longest_low")} | {"samples": 0, "evidence": False})


def corridor_budget(rows: DataFrame, n: int = 3) -> DataFrame:
    """Corridors (scene, id, a, b, ax, ay, bx, by, score, status) with deduplicated and budget_excluded.

    Of those between components a and b whose ends agree to one decimal the best stays; of those the n best proposed ones of each pair of
    components are in the budget. Best: highest score, then least id, which must be unique in a scene.
    """
    up = F.col("a") < F.col("b")
    end = lambda c: F.struct(F.bround(f"{c}x", 1).alias("x"), F.bround(f"{c}y", 1).alias("y"))
    best = F.struct((-F.col("score")).alias("s"), "id", "status")
    pair = [F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")]
    one = rows.groupBy(SCENE, *pair, F.when(up, end("a")).otherwise(end("b")).alias("e"), F.when(up, end("b")).otherwise(end("a")).alias("f")).agg(F.min(best).alias("m")).select(SCENE, "p", "q", "m.*")
    rank = F.row_number().over(Window.partitionBy(SCENE, "p", "q").orderBy("s", "id"))
    top = one.where("status = 'proposed'").withColumn("k", rank).where(F.col("k") <= n).select(SCENE, "id", F.lit(True).alias("__top"))
    out = rows.join(one.select(SCENE, "id", F.lit(True).alias("__one")), [SCENE, "id"], "left").join(top, [SCENE, "id"], "left")
    out = out.withColumn("deduplicated", F.col("__one").isNull())
    return out.withColumn("budget_excluded", F.col("deduplicated") | ((F.col("status") == "proposed") & F.col("__top").isNull())).drop("__one", "__top")
