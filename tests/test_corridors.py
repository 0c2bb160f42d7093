"""Least-cost paths over tiles against Dijkstra over single cells."""

import heapq
import math
import random

import numpy as np
import pytest

from terralane.operators import corridors as co


def dijkstra(cost, s, g, radius, box, corners=True):
    """Least cost between the disks around s and g; cost: {(x, y): value}."""
    x0, y0, x1, y1 = box
    ok = {p: c for p, c in cost.items() if x0 <= p[0] <= x1 and y0 <= p[1] <= y1}
    dist = {p: 0.0 for p in ok if math.dist(p, s) <= radius}
    queue = [(0.0, p) for p in dist]
    heapq.heapify(queue)
    while queue:
        d, p = heapq.heappop(queue)
        if d > dist[p]:
            continue
        if math.dist(p, g) <= radius:
            return d
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                q = (p[0] + dx, p[1] + dy)
                if q == p or q not in ok:
                    continue
                if dx and dy and not corners and ((p[0] + dx, p[1]) not in ok or (p[0], p[1] + dy) not in ok):
                    continue
                n = d + math.hypot(dx, dy) * (ok[p] + ok[q]) / 2
                if n < dist.get(q, math.inf):
                    dist[q] = n
                    heapq.heappush(queue, (n, q))
    return None


def path_cost(cost, path, corners=True):
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:]))
    if not corners:
        assert all((b[0], a[1]) in cost and (a[0], b[1]) in cost for a, b in zip(path, path[1:]))
    return sum(math.dist(a, b) * (cost[a] + cost[b]) / 2 for a, b in zip(path, path[1:]))


def raster(spark, costs, scene="s"):
    return spark.createDataFrame([(scene, x, y, float(c)) for (x, y), c in costs.items()], "scene_id string, x int, y int, cost double")


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "scene_id string, id long, sx double, sy double, gx double, gy double")


def check(out, pairs, costs, radius, margin, corners=True):
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == len(pairs)
    for _, i, sx, sy, gx, gy in pairs:
        box = (math.floor(min(sx, gx) - margin), math.floor(min(sy, gy) - margin), math.ceil(max(sx, gx) + margin), math.ceil(max(sy, gy) + margin))
        want = dijkstra(costs, (sx, sy), (gx, gy), radius, box, corners)
        assert rows[i].found == (want is not None), i
        if want is not None:
            path = [(p.x, p.y) for p in rows[i].path]
            assert abs(rows[i].cost - want) < 1e-6 and abs(path_cost(costs, path, corners) - want) < 1e-6
            assert math.dist(path[0], (sx, sy)) <= radius and math.dist(path[-1], (gx, gy)) <= radius
            assert all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in path)
    return rows


@pytest.mark.parametrize("tile", [32, 64])
def test_equals_dijkstra_on_128_squared(spark, tile):
    rng = np.random.default_rng(tile)
    smooth = rng.random((16, 16)).repeat(8, axis=0).repeat(8, axis=1)
    costs = {(x, y): 1 + 8 * (1 - smooth[y, x]) ** 2 + rng.random() for x in range(128) for y in range(128) if rng.random() > 0.08}
    rnd = random.Random(1)
    pairs = [("s", i, *(rnd.uniform(0, 127) for _ in range(4))) for i in range(14)]
    pairs += [("s", 90, 5.0, 5.0, 5.5, 5.0), ("s", 91, 0.0, 0.0, 500.0, 500.0), ("s", 92, 63.5, 63.5, 64.5, 64.5)]
    check(co.least_cost_paths(pairs_of(spark, pairs), raster(spark, costs), 20.0, 3.0, tile=tile), pairs, costs, 3.0, 20.0)


def test_obstacle_and_detours_through_many_tiles(spark):
    # a serpentine: walls with alternating gaps, negative coordinates included
    costs = {(x, y): 1.0 for x in range(-20, 20) for y in range(-20, 20)}
    for k, x in enumerate(range(-14, 16, 8)):
        for y in range(-20, 20):
            if (y != -20) if k % 2 else (y != 19):
                costs.pop((x, y))
    pairs = [("s", 1, -19.0, 0.0, 18.0, 0.0), ("s", 2, -19.0, 0.0, -17.0, 18.0), ("s", 3, -19.0, 0.0, -14.0, 0.0)]
    rows = check(co.least_cost_paths(pairs_of(spark, pairs), raster(spark, costs), 100.0, 0.0, tile=16), pairs, costs, 0.0, 100.0)
    assert len(rows[1].path) > 150 and not rows[3].found


def test_straight_band_and_result_without_partitions(spark):
    costs = {(x, y): 1.0 if y == 12 else 9.0 for x in range(50) for y in range(30)}
    pairs = [("s", 1, 3.0, 12.0, 46.0, 12.0)]
    df, cells = pairs_of(spark, pairs), raster(spark, costs)
    a = co.least_cost_paths(df, cells, 64.0, 0.0, tile=16).collect()
    assert all(p.y == 12 for p in a[0].path)
    assert a == co.least_cost_paths(df.repartition(3), cells.repartition(7), 64.0, 0.0, tile=16).collect()


def test_nulls_empty_tables_and_other_scenes(spark):
    costs = {(x, y): 1.0 for x in range(5) for y in range(5)}
    pairs = [("s", 1, 0.0, 0.0, 4.0, 4.0), ("t", 2, 0.0, 0.0, 4.0, 4.0), ("s", 3, None, 0.0, 1.0, 1.0)]
    rows = {r.id: r for r in co.least_cost_paths(pairs_of(spark, pairs), raster(spark, costs), tile=4, radius=0.0).collect()}
    assert rows[1].found and not rows[2].found and not rows[3].found and rows[2].path is None
    assert co.least_cost_paths(pairs_of(spark, []), raster(spark, costs)).collect() == []
    assert not co.least_cost_paths(pairs_of(spark, pairs[:1]), raster(spark, {})).collect()[0].found


def test_grid_routes(spark):
    rng = np.random.default_rng(5)
    value = {(x, y): float(rng.random()) for x in range(40) for y in range(40)}
    free = {p: 1.0 for p, v in value.items() if v >= 0.35}
    cells = spark.createDataFrame([("s", x, y, v) for (x, y), v in value.items()], "scene_id string, x int, y int, value double")
    rnd = random.Random(2)
    pairs = [("s", i, *(float(rnd.randrange(40)) for _ in range(4))) for i in range(25)] + [("s", 99, 0.0, 0.0, 99.0, 0.0)]
    for r in co.grid_routes(pairs_of(spark, pairs), cells, 0.35, tile=16).collect():
        _, _, sx, sy, gx, gy = next(p for p in pairs if p[1] == r.id)
        if r.id == 99:
            assert r.reason == "endpoint_out_of_bounds"
            continue
        want = dijkstra(free, (sx, sy), (gx, gy), 0, (0, 0, 39, 39), False)
        assert r.reason == (None if want is not None else "disconnected" if (sx, sy) in free and (gx, gy) in free else "endpoint_blocked")
        if want is not None:
            assert abs(r.length - want) < 1e-9 and abs(path_cost(free, [(p.x, p.y) for p in r.path], False) - want) < 1e-9


def graph_of(spark, points, links):
    nodes = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "scene_id string, id long, x double, y double")
    edges = spark.createDataFrame([("s", u, v, math.dist(points[u], points[v])) for u, v in links], "scene_id string, u long, v long, length double")
    return nodes, edges


def test_seeds_and_third_component_split(spark):
    from terralane.operators.proposals import component_pairs

    points = [(5, 30), (15, 30), (85, 30), (95, 30), (50, 10), (50, 50)]
    nodes, edges = graph_of(spark, points, [(0, 1), (2, 3), (4, 5)])
    pairs = component_pairs(nodes, edges, 100.0, 3)
    seeds = {(r.a, r.b, r["rank"]): r for r in co.seed_pairs(pairs, nodes, edges, 100.0, 6).collect()}
    first = seeds[0, 2, 1]
    assert (first.source, first.target, first.distance) == (1, 2, 70.0)
    to_edge = seeds[0, 4, 1]  # the endpoint (15, 30) lies 35 from the place (50, 30) of the third component's edge
    assert (to_edge.source, to_edge.target, to_edge.u, to_edge.v, to_edge.distance) == (1, None, 4, 5, 35.0) and abs(to_edge.t - 0.5) < 1e-9
    cells = spark.createDataFrame([("s", x, y, 1.0) for x in range(100) for y in range(25, 36)], "scene_id string, x int, y int, value double")
    line = [(15.0, 30.0), (40.0, 30.0), (85.0, 30.0)]
    paths = spark.createDataFrame([("s", 7, 0, 2, line), ("s", 8, 0, 4, [(15.0, 30.0), (50.0, 30.0)]), ("s", 9, 0, 2, [(1.0, 1.0)])], "scene_id string, id long, a long, b long, polyline array<struct<x: double, y: double>>")
    rows = {(r.id, r.part): r for r in co.split_corridors(paths, nodes, edges, cells).collect()}
    assert set(rows) == {(7, 0), (7, 1), (7, 2), (8, 0)}
    whole, left, right = rows[7, 0], rows[7, 1], rows[7, 2]
    assert whole.rejection_flags == ["third_component_requires_split"] and whole.status == "rejected_by_hard_gate" and [(s.component, round(s.position, 6)) for s in whole.stops] == [(4, 35.0)]
    assert (left.a, left.b, left.start, round(left.stop, 6), left.status) == (0, 4, 0.0, 35.0, "proposed") and (right.a, right.b, round(right.start, 6), right.stop) == (4, 2, 35.0, 70.0)
    assert [(round(p.x, 6), p.y) for p in left.polyline] == [(15.0, 30.0), (40.0, 30.0), (50.0, 30.0)] and rows[8, 0].status == "proposed"
    far = {r.part: r for r in co.split_corridors(paths.where("id = 7"), nodes, edges, cells.limit(0), max_length=30.0).collect()}
    assert all("max_corridor_length" in r.rejection_flags and r.mean == 0.5 for r in far.values())


def test_evidence_gates_and_repeated_components(spark):
    # the corridor meets the component of 4, 5 twice in a row, then that of 6, 7
    points = [(5, 30), (15, 30), (85, 30), (95, 30), (40, 10), (40, 50), (70, 10), (70, 50), (46, 10), (46, 50)]
    nodes, edges = graph_of(spark, points, [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9), (5, 9)])
    cells = spark.createDataFrame([("s", x, y, 0.0) for x in range(100) for y in range(60)], "scene_id string, x int, y int, value double")
    paths = spark.createDataFrame([("s", 1, 0, 2, [(15.0, 30.0), (85.0, 30.0)])], "scene_id string, id long, a long, b long, polyline array<struct<x: double, y: double>>")
    rows = {r.part: r for r in co.split_corridors(paths, nodes, edges, cells).collect()}
    assert [(s.component, round(s.position, 6)) for s in rows[0].stops] == [(4, 25.0), (4, 31.0), (6, 55.0)]
    assert [(rows[k].a, rows[k].b, round(rows[k].start, 6), round(rows[k].stop, 6)) for k in (1, 2, 3)] == [(0, 4, 0.0, 25.0), (4, 6, 25.0, 55.0), (6, 2, 55.0, 70.0)]
    assert all({"min_mean_probability", "min_p10_probability"} <= set(r.rejection_flags) for r in rows.values())


def test_component_without_endpoints_seeds_from_its_extremes(spark):
    points = [(0, 0), (10, 0), (10, 10), (0, 10), (40, 5), (60, 5)]
    nodes, edges = graph_of(spark, points, [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5)])
    pairs = spark.createDataFrame([("s", 0, 4)], "scene_id string, a long, b long")
    best = co.seed_pairs(pairs, nodes, edges).where("rank = 1").collect()[0]
    assert (best.source_component, best.source, best.u, best.v, best.distance) == (4, 4, 1, 2, 30.0)
