"""Findings of round 3, last part: steps whose tables grew with pairs, or that moved all edges where a few are used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terralane.functions.beside import Lines
from terralane.operators import clean, proposals, refine as rf
from terralane.operators.routing import route_geometry, straight_routes


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def sent(df) -> str:
    """The plan as Spark would run it without its own guess of what is small."""
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def graph(spark, points, edges):
    return spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(points)], "scene_id int, id long, x double, y double"), spark.createDataFrame([(0, u, v) for u, v in edges], "scene_id int, u long, v long").withColumn("length", F.lit(1.0))


def ladder(spark, n: int = 6):
    """n parallel lines of 100, 5 apart."""
    return graph(spark, [(x, 5 * k) for k in range(n) for x in (0, 100)], [(2 * k, 2 * k + 1) for k in range(n)])


def test_f18_candidate_pairs_of_chains_stay_in_their_task(spark):
    nodes, edges = ladder(spark)
    out = rf.parallel_chains(nodes, edges, distance=12.0)
    assert "Join" not in optimized(out)
    assert sorted((r.a[0], r.b[0]) for r in out.collect()) == [(2 * i, 2 * j) for i in range(6) for j in range(i + 1, 6) if j - i <= 2]


def test_f18_places_and_distances_follow_bent_lines():
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = Lines(pa.array([line((0, 0), (10, 0), (10, 10)), line((0, 3), (10, 3))]), 5)
    assert np.allclose(lines.px[0], [0, 5, 10, 10, 10]) and np.allclose(lines.py[0], [0, 0, 0, 5, 10])
    assert lines.near(np.array([0, 1]), np.array([1, 0]), 3.0).tolist() == [4, 5]


def test_f32_straight_routes_are_those_of_route_geometry(spark):
    nodes, edges = graph(spark, [(0, 0), (3, 4), (3, 9), (0, 9)], [(0, 1), (1, 2), (2, 3), (0, 3)])
    routes = spark.createDataFrame([(0, 1, [0, 1]), (0, 2, [2, 1, 0]), (0, 3, [0, 1, 2, 3, 0])], "scene_id int, id int, path array<long>")
    rows = lambda df: sorted((r.id, [tuple(p) for p in r.polyline], round(r.length, 9), r.detour) for r in df.collect())
    out = straight_routes(routes, nodes)
    assert rows(out) == rows(route_geometry(routes, nodes, edges)) and "SortMergeJoin" not in sent(straight_routes(routes, nodes))


def test_f32_edges_between_chain_ends_are_not_shuffled_for_their_chains(spark):
    nodes, edges = graph(spark, [(0, 0), (1, 0), (0, 1), (1, 1)], [(a, b) for a in range(4) for b in range(a + 1, 4)])
    out = clean.chains(nodes, edges, nodes)
    assert "SortMergeJoin" not in sent(clean.chains(nodes, edges, nodes)) and out.count() == 6


def test_f34_tangents_look_up_no_edges(spark, monkeypatch):
    from terralane.operators import routing

    nodes, edges = graph(spark, [(0, 0), (10, 0), (20, 0)], [(0, 1), (1, 2)])
    monkeypatch.setattr(routing, "route_geometry", None)
    assert sorted((r.id, round(r.tx, 6)) for r in proposals.endpoint_tangents(nodes, edges).collect()) == [(0, -1.0), (2, 1.0)]


def test_f48_straight_edges_are_contracted_without_their_lines(spark):
    nodes, edges = graph(spark, [(0, 0), (1, 0), (9, 0), (9, 5)], [(0, 2), (1, 2), (1, 3), (0, 1)])
    to = spark.createDataFrame([(0, 1, 0)], "scene_id int, id long, to long")
    kept, out = clean.contract(nodes, edges, to)
    grouped = [x for x in optimized(out).splitlines() if "Aggregate" in x]
    assert grouped and not any("polyline" in x or "_at" in x for x in grouped)
    assert sorted((r.u, r.v, round(r.length, 6), [tuple(p) for p in r.polyline]) for r in out.collect()) == [(0, 2, 9.0, [(0.0, 0.0), (9.0, 0.0)]), (0, 3, round(106**0.5, 6), [(0.0, 0.0), (9.0, 5.0)])]


def test_f49_bridges_write_no_lines_of_other_edges(spark, monkeypatch):
    written = {}
    keep = rf.stored

    def noted(df, name="step"):
        written[name] = keep(df, name)
        return written[name]

    monkeypatch.setattr(rf, "stored", noted)
    square = [(0, 50), (10, 50), (0, 60), (10, 60)]
    nodes, edges = graph(spark, [(0, 0), (10, 0), (20, 0), (30, 0), *square], [(0, 1), (2, 3), *((4 + a, 4 + b) for a in range(4) for b in range(a + 1, 4))])
    cells = spark.createDataFrame([(0, x, 0, 1.0) for x in range(40)], "scene_id int, x int, y int, value double")
    out = rf.bridge(nodes, edges, cells)
    assert [(r.a, r.b) for r in out.where("accepted").collect()] == [(1, 2)]
    assert "lines" not in written and written["last"].count() == 2


def test_f40_f42_few_endpoints_go_to_the_edges(spark):
    nodes, edges = graph(spark, [(0, 0), (10, 0), (20, 5), (30, 5), (20, -5), (30, -5)], [(0, 1), (2, 3), (4, 5)])
    assert "SortMergeJoin [scene_id" not in sent(proposals.near_segments(nodes, edges.withColumns({"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(1.0), "y1": F.lit(0.0)}), 60.0))


def test_f31_rows_come_into_the_budget_some_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(0, int(a), int(b), float(s), "rejected" if s == 0 else "accepted") for (a, b), s in zip({(min(p), max(p)) for p in rng.integers(0, 12, (60, 2)).tolist() if p[0] != p[1]}, rng.integers(0, 6, 60) / 5)]
    df = spark.createDataFrame(rows, "scene_id int, a long, b long, score double, status string")
    room, want = {}, sorted(r for r in rows if r[4] == "rejected")
    for r in sorted((r for r in rows if r[4] != "rejected"), key=lambda r: (-r[3], r[1], r[2])):
        if max(room.get(r[1], 0), room.get(r[2], 0)) < 2:
            want.append(r)
            room[r[1]], room[r[2]] = room.get(r[1], 0) + 1, room.get(r[2], 0) + 1
    seen = []
    keep = proposals._both
    monkeypatch.setattr(proposals, "_both", lambda rows, *rest: (seen.append(rows.count()), keep(rows, *rest))[1])
    out = proposals.budget_both(df, 2, [F.desc("score"), F.col("a"), F.col("b")], lead=-F.col("score"), most=12)
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(seen) > 1 and sum(seen) < len(rows)
