"""Small graphs, grids and files with known results."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terralane.functions import geom
from terralane.operators import features, graph, labels, manifest, routing
from terralane.operators.components import connected_components
from terralane.sources import readers


def graph_of(spark, points, pairs):
    nodes = spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(points)], "scene_id string, id long, x double, y double")
    rows = [("s", min(u, v), max(u, v), math.dist(points[u], points[v])) for u, v in pairs]
    return nodes, spark.createDataFrame(rows, "scene_id string, u long, v long, length double")


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    group = {x: x for p in pairs for x in p if p[0] != p[1]}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in pairs:
        if u != v:
            a, b = sorted((root(u), root(v)))
            group[b] = a
    least = {}
    for x in group:
        least[root(x)] = min(least.get(root(x), x), x)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: least[root(x)] for x in group}


def test_bridges(spark):
    _, e = graph_of(spark, [(0, 0)] * 8, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7)])
    assert {(r.u, r.v) for r in graph.bridges(e).where("bridge").collect()} == {(2, 3), (6, 7)}


def test_routes(spark):
    n, e = graph_of(spark, [(0, 0), (40, 0), (40, 30), (100, 100), (140, 100)], [(0, 1), (1, 2), (3, 4)])
    pairs = spark.createDataFrame([("s", 1, 0.0, 1.0, 40.0, 30.0), ("s", 2, 5.0, 0.0, 35.0, 0.0), ("s", 3, 0.0, 0.0, 140.0, 100.0), ("s", 4, 900.0, 0.0, 0.0, 0.0)], "scene_id string, id long, sx double, sy double, gx double, gy double")
    got = {r.id: (r.success, None if r.length is None else round(r.length, 6), r.failure) for r in routing.routes(routing.attach(pairs, n, e, 20.0), e).collect()}
    assert got == {1: (True, 70.0, None), 2: (True, 30.0, None), 3: (False, None, "disconnected"), 4: (False, None, "projection")}


def test_routes_of_random_graphs(spark):
    rng = random.Random(3)
    points = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(25)]
    edges = [p for p in itertools.combinations(range(25), 2) if math.dist(points[p[0]], points[p[1]]) < 80]
    n, e = graph_of(spark, points, edges)
    d = {(i, j): 0.0 if i == j else math.inf for i in range(25) for j in range(25)}
    for u, v in edges:
        d[u, v] = d[v, u] = math.dist(points[u], points[v])
    for k, i, j in itertools.product(range(25), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    linked = sorted({x for p in edges for x in p})
    rows = [("s", k, *points[a], *points[b]) for k, (a, b) in enumerate(itertools.combinations(linked[:8], 2))]
    pairs = spark.createDataFrame(rows, "scene_id string, id long, sx double, sy double, gx double, gy double")
    for r in routing.routes(routing.attach(pairs, n, e, 5.0), e).collect():
        a, b = list(itertools.combinations(linked[:8], 2))[r.id]
        assert (r.length is None and d[a, b] == math.inf) or abs(r.length - d[a, b]) < 1e-6


def test_route_queries_take_every_point(spark):
    from types import SimpleNamespace

    from terralane.queries import routing as queries

    rng = random.Random(4)
    points = [(rng.uniform(0, 0.2), rng.uniform(0, 0.2)) for _ in range(14)]
    t = SimpleNamespace(embeddings=spark.createDataFrame([(i, 0, [x, y]) for i, (x, y) in enumerate(points)], "vec_id long, label int, embedding array<double>"))
    at = [(1000 * x, 1000 * y) for x, y in points]
    edges = [p for p in itertools.combinations(range(14), 2) if math.dist(at[p[0]], at[p[1]]) <= 60]
    d = {(i, j): 0.0 if i == j else math.inf for i in range(14) for j in range(14)}
    for u, v in edges:
        d[u, v] = d[v, u] = math.dist(at[u], at[v])
    for k, i, j in itertools.product(range(14), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])

    def nearest(x, y):
        found = []
        for u, v in edges:
            (a, b), (p, q) = at[u], at[v]
            k = max(0, min(1, ((x - a) * (p - a) + (y - b) * (q - b)) / math.dist(at[u], at[v]) ** 2))
            found.append((round(math.dist((x, y), (a + k * (p - a), b + k * (q - b))), 9), u, v, k))
        return min((f for f in found if f[0] <= 40), default=None)

    starts, want = {}, {}
    for i in range(12):
        s, g = nearest(at[i][0] + 3, at[i][1] - 2), nearest(at[i + 2][0] - 1, at[i + 2][1] + 4)
        if s:
            starts[i] = s[1:3]
        if not s or not g:
            want[i] = (None, "projection")
            continue
        (_, u, v, k), (_, a, b, m) = s, g
        w, z = math.dist(at[u], at[v]), math.dist(at[a], at[b])
        ways = [x + d[n, e] + y for n, x in ((u, k * w), (v, (1 - k) * w)) for e, y in ((a, m * z), (b, (1 - m) * z))]
        best = min([*ways, abs(k - m) * w] if (u, v) == (a, b) else ways)
        want[i] = (None, "disconnected") if best == math.inf else (best, None)
    got = {r.id: (r.length, r.failure) for r in queries.results(t).collect()}
    assert got.keys() == want.keys() and any(w[0] for w in want.values())
    assert all(got[i][1] == f and (n is None) == (got[i][0] is None) and abs((n or 0) - (got[i][0] or 0)) < 1e-6 for i, (n, f) in want.items())
    assert {r.id: (r.u, r.v) for r in queries.project_starts(t, queries.pairs(t)).collect()} == starts


def test_budget_counts_both_ends(spark):
    from terralane.operators import proposals

    rng = random.Random(5)
    rows = [("s", a, b, rng.randrange(6), rng.choice(("accepted", "accepted", "rejected"))) for a, b in itertools.combinations(range(9), 2)] + [("t", i, 50, i, "accepted") for i in range(6)]
    room, want = {}, set()
    for s, a, b, _, status in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if status == "rejected":
            want.add((s, a, b))
        elif room.get((s, a), 0) < 2 and room.get((s, b), 0) < 2:
            want.add((s, a, b))
            for x in (a, b):
                room[s, x] = room.get((s, x), 0) + 1
    df = spark.createDataFrame(rows, "scene_id string, a long, b long, score long, status string")
    assert {(r.scene_id, r.a, r.b) for r in proposals.budget_both(df, 2, [F.desc("score"), F.col("a"), F.col("b")]).collect()} == want


def test_endpoint_budget_marks_what_has_no_room(spark):
    from terralane.operators import proposals

    rng = random.Random(8)
    rows = [("s", rng.choice(("endpoint_endpoint", "endpoint_edge", "endpoint_junction")), a, b, rng.randrange(5) / 4, rng.choice(("proposed", "proposed", "proposed", "rejected_by_hard_gate"))) for a, b in itertools.combinations(range(9), 2)]
    rows += [("t", "endpoint_edge", 1, b, 0.5, "proposed") for b in range(6)] + [("t", "endpoint_endpoint", 1, 1, 0.9, "proposed")]
    room, want = {}, {}
    for s, kind, a, b, _, status in sorted(rows, key=lambda r: (-r[4], r[1], r[2], r[3])):
        ends = {a, b} if kind == "endpoint_endpoint" else {a}
        out = status == "proposed" and any(room.get((s, x), 0) >= 2 for x in ends)
        want[s, kind, a, b] = out
        if status == "proposed" and not out:
            for x in ends:
                room[s, x] = room.get((s, x), 0) + 1
    df = spark.createDataFrame(rows, "scene_id string, kind string, a long, b long, score double, status string")
    got = {(r.scene_id, r.kind, r.a, r.b): r.budget_excluded for r in proposals.endpoint_budget(df, 2).collect()}
    assert got == want and 5 < sum(want.values()) < 35
    assert proposals.endpoint_budget(df.limit(0)).collect() == []


def test_curved_edge_and_runs(spark):
    poly = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (5, 5), (10, 0))))
    r = spark.range(1).select(geom.arc_length(poly).alias("l"), geom.project(10.0, 3.0, poly).alias("p"), geom.longest_run(F.array(*(F.lit(v) for v in (True, True, False, True)))).alias("run"), geom.axis_count(F.array(*(F.lit(float(a)) for a in (0, 178, 90, 270, 45))), 15.0).alias("axes")).first()
    assert round(r.l, 4) == 14.1421 and round(r.p.d, 4) == 2.1213 and r.run == 2 and r.axes == 3


def test_inner_boundary_and_weights(spark):
    cells = spark.createDataFrame([("s", x, y, 2 <= x <= 7) for x in range(10) for y in range(6)], "scene_id string, x long, y long, mask boolean")
    got = {(r.x, r.y) for r in labels.inner_boundary(cells, 1).where("boundary").collect()}
    assert got == {(x, y) for x in range(2, 8) for y in range(6) if x in (2, 7) or y in (0, 5)}


def test_manifest_rules(spark):
    rows = spark.createDataFrame([("a", "False"), ("b", " True"), ("c", None)], "id string, ssl_allowed string")
    assert [r.id for r in manifest.allowed(rows).collect()] == ["b"]
    with pytest.raises(manifest.TableError):
        manifest.require(rows, ["path"])
    with pytest.raises(manifest.TableError):
        manifest.assert_disjoint(rows, rows, "id")
    with pytest.raises(manifest.TableError):
        manifest.hash_sample(rows.withColumn("dataset", F.lit("d")), ["dataset"], 5, 1)
    regions = spark.createDataFrame([("f", "a", "train", 0.0, 0.0, 100.0, 100.0), ("f", "b", "test", 101.0, 0.0, 200.0, 100.0), ("f", "c", "test", 1300.0, 0.0, 1400.0, 100.0)], "frame string, id string, split string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.id_a, r.id_b) for r in manifest.spatial_leakage(regions).collect()] == [("a", "b")]


def test_pca_follows_the_spread(spark):
    rng = random.Random(1)
    rows = [([3 * rng.gauss(0, 1) + 5, rng.gauss(0, 1), 0.1 * rng.gauss(0, 1)],) for _ in range(500)]
    df = spark.createDataFrame(rows, "embedding array<double>")
    m = features.pca_fit(df, 2).first()
    assert m.components[0][0] > 0.95 and abs(m.components[1][1]) > 0.95
    out = features.pca_transform(df, features.pca_fit(df, 2)).agg(F.avg(F.col("components")[0]).alias("m")).first()
    assert abs(out.m) < 1e-9
    assert 1 < features.effective_rank(df).first().effective_rank < 3


def test_graph_files(spark, tmp_path):
    (tmp_path / "g").mkdir()
    files = {
        "a": {"nodes_rc": [[3, 40], [5, 60]], "edges": [[1, 0]]},
        "b": {"edges": []},
        "c": {"nodes": [[0, 0]], "nodes_rc": [[0, 0]], "edges": []},
    }
    for name, content in files.items():
        (tmp_path / "g" / f"{name}.json").write_text(json.dumps(content))
    nodes, edges, audit = readers.read_graphs(spark, f"file://{tmp_path}/g")
    assert {(r.scene_id, r.id, r.x, r.y) for r in nodes.collect()} == {("a", 0, 40.0, 3.0), ("a", 1, 60.0, 5.0)}
    (e,) = edges.collect()
    assert (e.u, e.v) == (0, 1) and e.polyline[0].x == 40.0 and abs(e.length - math.hypot(20, 2)) < 1e-9
    assert {(r.scene_id, r.error) for r in audit.collect()} == {("b", "axis order not declared"), ("c", "two axis orders")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text(json.dumps({"nodes": [{"id": 5, "x": 0, "y": 0}, {"id": 2, "x": 10, "y": 0}], "edges": [{"source": 5, "target": 2, "geometry": [[10, 0], [5, 5], [0, 0]]}]}))
    _, edges, _ = readers.read_graphs(spark, f"file://{tmp_path}/t", "tolerant")
    (e,) = edges.collect()
    assert (e.u, e.v) == (2, 5) and [p.x for p in e.polyline] == [10.0, 5.0, 0.0] and round(e.length, 4) == 14.1421
    n, g = readers.rescale(*readers.read_graphs(spark, f"file://{tmp_path}/t", "tolerant")[:2], 2.0, 1.0)
    assert n.agg(F.max("x")).first()[0] == 20.0
    readers.write_graph(n, g, f"file://{tmp_path}/out", {"frame": "original"})
    assert spark.read.json(f"file://{tmp_path}/out").first().frame == "original"


def test_cvat_and_truth(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<annotations><image id="0" name="img_1.png" width="100" height="50"><polyline label="path" points="0,0;3,4"/><polyline label="path" points="1,1"/><polyline label="wall" points="0,0;1,1"/></image></annotations>')
    (r,) = readers.read_cvat(spark, f"file://{tmp_path}/a.xml").collect()
    assert (r.scene_id, r.width, len(r.points), r.points[1].y) == ("img_1", 100, 2, 4.0)
    good = {"annotation_status": "human_reviewed", "coverage_complete": True, "image_size": [100, 50], "nodes": [{"id": 1, "x": 0, "y": 0}, {"id": 2, "x": 9, "y": 9}], "edges": [{"source": 1, "target": 2, "polyline": [[0, 0], [9, 9]]}]}
    (tmp_path / "gt").mkdir()
    for name, change in (("ok", {}), ("draft", {"annotation_status": "draft"}), ("off", {"edges": [{"source": 1, "target": 2, "polyline": [[0, 1], [9, 9]]}]}), ("out", {"image_size": [5, 5]})):
        (tmp_path / "gt" / f"{name}.json").write_text(json.dumps(good | change))
    ok, bad = readers.read_gt(spark, f"file://{tmp_path}/gt", 100, 50)
    assert [r.scene_id for r in ok.collect()] == ["ok"]
    assert {(r.scene_id, tuple(r.errors)) for r in bad.collect()} == {("draft", ("not reviewed",)), ("off", ("edge ends off their nodes",)), ("out", ("frame",))}


def test_rasters_annotations_and_pairs(spark, tmp_path):
    import io

    import numpy as np

    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    (tmp_path / "r").mkdir()
    np.save(tmp_path / "r" / "scene.npy", a)
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/r")
    cells = readers.raster_cells(readers.ingest_raster(files, "road", lambda b: np.load(io.BytesIO(b)), 2), 2).collect()
    assert {(r.x, r.y): round(r.value * 255) for r in cells} == {(x, y): int(a[y, x]) for x in range(4) for y in range(3)}
    (tmp_path / "ann.json").write_text(json.dumps([{"source_subgraph_id": "s1", "component_validity": "REAL", "endpoint_labels": {"3": {"selection": "NO_CONNECT"}, "4": {"selection": "c_candidate_2"}}}, {"source_subgraph_id": "s2", "component_validity": "FALSE", "endpoint_labels": {}}]))
    rows = readers.read_annotations(spark, f"file://{tmp_path}/ann.json").collect()
    assert {(r.source_id, r.endpoint, r.selection) for r in rows} == {("s1", "3", "NO_CONNECT"), ("s1", "4", "c_candidate_2"), ("s2", None, None)}
    listing = spark.createDataFrame([("Train/Urban/images_png/1.png",), ("Train/Urban/masks_png/1.png",), ("Train/Urban/images_png/2.png",), ("Val/Urban/images_png/3.png",)], "path string")
    pairs, problems = readers.discover_pairs(listing, "Train", "Urban")
    assert [r.id for r in pairs.collect()] == ["1"] and [(r.id, r.problem) for r in problems.collect()] == [("2", "missing label")]
    seg = spark.createDataFrame([("s", 0.0, 0.0, 1.0, 1.0), ("s", 1.0, 1.0, 0.0, 0.0), ("s", 2.0, 2.0, 2.0, 2.0)], "scene_id string, x0 double, y0 double, x1 double, y1 double")
    nodes, edges = readers.segments_to_graph(seg)
    assert nodes.count() == 3 and [(r.u, r.v) for r in edges.collect()] == [(0, 1)]
