"""What the fourth round's findings were about, on small rows."""

import itertools
import math
import random

import numpy as np

from terralane.functions import spatial
from terralane.operators import graph, refine, routing, simplify


def graph_rows(seed, scenes=2, n=30, share=0.15):
    draw = random.Random(seed)
    return sorted((s, u, v) for s in range(scenes) for u, v in itertools.combinations(range(n), 2) if draw.random() < share)


def in_triangles(rows):
    near = {}
    for s, u, v in rows:
        near.setdefault((s, u), set()).add(v)
        near.setdefault((s, v), set()).add(u)
    return {(s, u, v) for s, u, v in rows if near[s, u] & near[s, v]}


def test_chords_are_those_of_all_edges_however_these_are_dealt(spark):
    for seed, parts, share in ((1, 1, 0.15), (2, 7, 0.1), (3, 16, 0.3)):
        rows = graph_rows(seed, share=share)
        e = spark.createDataFrame(rows + rows[:5] + [(0, 4, 4)], "scene_id int, u long, v long").repartition(parts)
        got = [tuple(r) for r in graph.chord_edges(e).select("scene_id", "u", "v").collect()]
        assert len(got) == len(set(got)) and set(got) == in_triangles(rows)


def test_edges_in_triangles_of_their_own_task_are_not_dealt_to_blocks(spark, monkeypatch):
    rows = [(0, u, v) for u, v in itertools.combinations(range(12), 2)]
    monkeypatch.setattr(graph, "by_blocks", None)
    assert graph.chord_edges(spark.createDataFrame(rows, "scene_id int, u long, v long").coalesce(1)).count() == len(rows)


def test_edges_that_find_no_triangle_soon_try_all_neighbours():
    # a node of 200 edges and one of 100, with a single common neighbour
    rows = sorted({(0, 1), *((0, k) for k in range(2, 202)), *((1, k) for k in range(201, 301))})
    u, v = np.array(rows).T
    closed = graph.closing_edges(u, v, 301)
    assert {r for r, c in zip(rows, closed, strict=True) if c} == {(0, 1), (0, 201), (1, 201)}


def nearest_by_hand(points, segments, radius):
    out = {}
    for s, p, x, y in points:
        found = []
        for s2, u, v, x0, y0, x1, y1 in segments:
            if s2 == s:
                dx, dy = x1 - x0, y1 - y0
                t = min(1.0, max(0.0, ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                d = math.hypot(x - x0 - t * dx, y - y0 - t * dy)
                if d <= radius:
                    found.append((round(d, 9), u, v))
        if found:
            out[s, p] = min(found)
    return out


def test_nearest_segments_are_the_first_of_equal_ones(spark, monkeypatch):
    draw = random.Random(4)
    # places on a grid, so many segments are equally far
    places = [(s, draw.randrange(60), draw.randrange(60)) for s in (0, 1) for _ in range(40)]
    segments = [(s, i, i + draw.randrange(3), float(x), float(y), x + draw.randrange(-9, 10) * 1.0, y + draw.randrange(-9, 10) * 1.0) for i, (s, x, y) in enumerate(places * 3)]
    points = [(s, i, x + draw.choice((0.0, 0.5, 7.0)), float(y)) for i, (s, x, y) in enumerate(places)] + [(2, 999, 1.0, 1.0), (0, 1000, 500.0, 500.0)]
    want = nearest_by_hand(points, segments, 6.0)
    p = spark.createDataFrame(points, "scene_id int, id long, x double, y double")
    e = spark.createDataFrame(segments, "scene_id int, u long, v long, x0 double, y0 double, x1 double, y1 double").repartition(5)
    for few in (1 << 20, 3):
        monkeypatch.setattr(spatial, "FEW_ROWS", few)
        rows = spatial.nearest_segment(p, e, 6.0, "scene_id", ["id"], ["u", "v"]).collect()
        assert {(r.scene_id, r.id): (round(r.distance, 9), r.u, r.v) for r in rows} == want and len(rows) == len(want)


def test_nearest_segments_leave_a_task_as_one_row_a_point(spark):
    segments = [(0, u, u + 1, 0.0, u / 100, 10.0, u / 100) for u in range(500)]
    e = spark.createDataFrame(segments, "scene_id int, u long, v long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    p = spark.createDataFrame([(0, 7, 5.0, 2.0), (0, 8, 5.0, 4.0)], "scene_id int, id long, x double, y double")
    rows = spatial.nearest_segment(p, e, 40.0, "scene_id", ["id"], ["u", "v"])
    assert [(r.id, r.u, r.t) for r in rows.orderBy("id").collect()] == [(7, 200, 0.5), (8, 400, 0.5)]
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_routes_in_tasks_are_those_by_rounds(spark, monkeypatch):
    draw = random.Random(5)
    places = {(s, i): (draw.uniform(0, 60), draw.uniform(0, 60)) for s in (0, 1, 2) for i in range(25)}
    length = {(s, u, v): math.dist(places[s, u], places[s, v]) for s, u, v in graph_rows(6, scenes=2, n=25, share=0.5)}
    length = {e: d for e, d in length.items() if d < 22} | {(1, 90, 91): 3.0, (1, 91, 92): 0.0, (1, 92, 93): 0.0}
    links = [e for e in length if e[1] < 90]
    end = lambda e: ((e[1], e[2]), draw.choice((0.0, 0.25, 1.0)))
    pairs = [(s, i, *end(draw.choice([e for e in links if e[0] == s])), *end(draw.choice([e for e in links if e[0] == s]))) for i, s in enumerate([0, 1] * 20)]
    pairs += [(1, 50, (90, 91), 0.5, (92, 93), 0.5), (1, 51, *end(links[-1]), (92, 93), 0.5), (1, 52, (90, 91), 0.25, (90, 91), 0.75), (2, 53, None, None, (1, 2), 0.5)]
    side = lambda e, t: e and (*e, t, 0.0)
    rows = [(s, i, side(a, t), side(b, r)) for s, i, a, t, b, r in pairs]
    at = spark.createDataFrame(rows, "scene_id int, id long, s struct<u: long, v: long, t: double, distance: double>, g struct<u: long, v: long, t: double, distance: double>")
    e = spark.createDataFrame([(*k, d) for k, d in length.items()], "scene_id int, u long, v long, length double")
    monkeypatch.setattr(routing, "TASK_PAIRS", 8)

    def got():
        return {(r.scene_id, r.id): (r.success, r.length and round(r.length, 9), r.failure, r.path and len(r.path)) for r in routing.scene_routes(at, e).collect()}

    monkeypatch.setattr(routing, "routes", None)
    in_tasks = got()
    monkeypatch.undo()
    monkeypatch.setattr(routing, "GRAPH_EDGES", 0)
    assert got() == in_tasks and in_tasks[1, 51][2] == "disconnected" and in_tasks[1, 50][:2] == (True, 1.5) and in_tasks[1, 52][3] == [] and in_tasks[2, 53][2] == "projection"


def test_edges_of_scenes_that_fit_are_decided_in_tasks_as_in_rounds(spark, monkeypatch):
    places = {}
    for s in range(4):
        draw = random.Random(40 + s)
        for i in range(16):
            t = draw.uniform(0, 100)
            places[s, i] = (t, 50 + draw.uniform(-3, 3)) if i % 2 else (50 + draw.uniform(-3, 3), t)
    links = [(s, u, v, u * 0.1) for s, u in places for v in range(u + 1, 16) if math.dist(places[s, u], places[s, v]) < 30]
    nodes = spark.createDataFrame([(*k, *p) for k, p in places.items()], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame(links, "scene_id int, u long, v long, score double")
    junctions = simplify.branches(nodes, edges).where("role = 'JUNCTION_LIKE'").select("scene_id", "id", "branch_count")
    guard = simplify.Guard(nodes, edges, junctions, 15.0)

    def got():
        chords = simplify.remove_chords(nodes, edges, guard).select("scene_id", "u", "v", "removed", "reason", "way.path", "way.ratio", "alternative.path")
        doubles = simplify.remove_duplicates(nodes, edges, guard).select("scene_id", "u", "v", "removed", "reason", "alternative.path")
        return sorted(map(str, chords.collect())), sorted(map(str, doubles.collect()))

    monkeypatch.setattr(simplify, "remove_in_order", None)
    in_tasks = got()
    monkeypatch.undo()
    monkeypatch.setattr(simplify, "TASK_NODES", 0)
    assert got() == in_tasks and len(in_tasks[0]) == len(links) and in_tasks[1]


def test_greedy_in_tasks_is_one_pass_in_order(spark, monkeypatch):
    draw, rows = random.Random(7), []
    for s in range(3):
        for k, (a, b) in enumerate(draw.sample([(a, b) for a in range(14) for b in range(a + 1, 14)], 40)):
            rows.append((s, (round(draw.random(), 1), a, b), a, b, draw.random() < 0.8, a // 2, b // 2, k))
    items = spark.createDataFrame(rows, "scene_id int, key struct<d: double, a: long, b: long>, a long, b long, ok boolean, ca long, cb long, note int")
    for groups in (None, ("ca", "cb")):
        some = items if groups else items.drop("ca", "cb")
        want = sorted(map(str, refine.greedy(some, ("a", "b"), groups).select("scene_id", "key", "a", "b", "note", "accepted", "same").collect()))
        with monkeypatch.context() as m:
            m.setattr(refine, "greedy", None)
            got = refine.scene_greedy(some, ("a", "b"), groups).select("scene_id", "key", "a", "b", "note", "accepted", "same").collect()
            assert sorted(map(str, got)) == want and any(r.accepted for r in got)
    monkeypatch.setattr(refine, "TASK_ITEMS", 1)
    got = refine.scene_greedy(items, ("a", "b"), ("ca", "cb")).select("scene_id", "key", "a", "b", "note", "accepted", "same").collect()
    assert sorted(map(str, got)) == want
