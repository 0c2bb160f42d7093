"""Chains, spurs and contraction on small graphs."""

from pyspark.sql import functions as F

from terralane.operators import clean


def graph(spark, points, pairs):
    nodes = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in points.items()], "scene_id long, id long, x double, y double")
    edges = [(0, min(u, v), max(u, v), ((points[u][0] - points[v][0]) ** 2 + (points[u][1] - points[v][1]) ** 2) ** 0.5) for u, v in pairs]
    return nodes, spark.createDataFrame(edges, "scene_id long, u long, v long, length double")


def paths(rows):
    return sorted((tuple(r.path), round(r.length, 3), r.closed) for r in rows.collect())


def test_chains_of_a_long_line_a_ring_and_a_loop(spark):
    # a line of 41 nodes, a ring of five, and a loop of three on a junction with a tail
    line = {i: (i, 0) for i in range(41)}
    ring = {100 + i: (i, 50 + (i % 2)) for i in range(5)}
    loop = {200: (0, 100), 201: (1, 101), 202: (1, 99), 203: (-3, 100)}
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 5) for i in range(5)] + [(200, 201), (201, 202), (202, 200), (200, 203)]
    got = paths(clean.chains(*graph(spark, line | ring | loop, pairs)))
    assert [(p, c) for p, _, c in got] == [(tuple(range(41)), False), ((100, 101, 102, 103, 104, 100), True), ((200, 201, 202, 200), True), ((200, 203), False)]
    assert got[0][1] == 40.0


def test_spurs_go_only_without_evidence(spark):
    points = {0: (0, 0), 1: (20, 0), 2: (40, 0), 3: (20, 10), 4: (40, 10), 5: (60, 0)}
    nodes, edges = graph(spark, points, [(0, 1), (1, 2), (1, 3), (2, 4), (2, 5)])
    cells = spark.createDataFrame([(0, x, y, 0.9) for x in range(61) for y in (0,)] + [(0, 40, y, 0.9) for y in range(11)], "scene_id long, x long, y long, value double")
    kept, left = clean.prune_spurs(nodes, edges, cells, max_length=15.0, small=0)
    assert sorted((r.u, r.v) for r in left.collect()) == [(0, 1), (1, 2), (2, 4), (2, 5)]
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 4, 5]
    # confident edges stay, and so does all without a raster
    sure = edges.withColumn("confidence", F.when(F.col("v") == 3, 0.5).otherwise(0.0))
    assert clean.prune_spurs(nodes, sure, cells, max_length=15.0, small=0)[1].count() == 5
    unsure = edges.withColumn("confidence", F.when(F.col("v") == 3, 0.4))
    assert clean.prune_spurs(nodes, unsure, cells, max_length=15.0, small=0)[1].count() == 4
    other = cells.withColumn("scene_id", F.lit(7).cast("long"))
    kept, left = clean.prune_spurs(nodes, edges, other, max_length=15.0, small=0)
    assert left.count() == 5 and kept.count() == 6
    # evidence is read along a bent edge's line, which leaves the cells of its ends
    bent = edges.withColumn("polyline", F.when(F.col("v") == 4, F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((40, 0), (48, 5), (40, 10))))))
    assert sorted((r.u, r.v) for r in clean.prune_spurs(nodes, bent, cells, max_length=15.0, small=0)[1].collect()) == [(0, 1), (1, 2), (2, 5)]


def test_config_by_name_as_a_sweep_makes_them(spark):
    rows = spark.createDataFrame([("base", 0.5, 0.5), ("base", 0.9, 0.5), ("k=2", 0.5, 0.4), ("k=2", 0.9, 0.5), ("a=3", 0.5, 0.4), ("a=3", 0.9, 0.5), ("b=9", 0.4, 0.0)], "config string, retention double, kept double")
    (r,) = clean.choose_config(rows).collect()
    assert (r.config, r.worst, r.runs) == ("a=3", 0.5, 2)
    assert clean.choose_config(rows.limit(0)).collect() == []


def test_contract_keeps_the_longer_parallel_edge_and_its_bends(spark):
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 10.0, 0.0), (0, 2, 10.0, 1.0)], "scene_id long, id long, x double, y double")
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    edges = spark.createDataFrame([(0, 0, 1, 10.0, line((0, 0), (10, 0))), (0, 0, 2, 14.0, line((0, 0), (5, 5), (10, 1))), (0, 1, 2, 1.0, line((10, 0), (10, 1)))], "scene_id long, u long, v long, length double, polyline array<struct<x:double,y:double>>")
    mapping = spark.createDataFrame([(0, 2, 1)], "scene_id long, id long, to long")
    kept, out = clean.contract(nodes, edges, mapping)
    assert sorted(r.id for r in kept.collect()) == [0, 1]
    (row,) = out.collect()
    assert (row.u, row.v) == (0, 1) and [(p.x, p.y) for p in row.polyline] == [(0.0, 0.0), (5.0, 5.0), (10.0, 0.0)]


def test_sweep_changes_one_factor(spark):
    out = clean.sweep(lambda a, b: spark.range(1).select(F.lit(a + b).alias("n")), {"a": 1, "b": 2}, {"a": [1, 5], "b": [3]})
    assert sorted((r.config, r.n) for r in out.collect()) == [("a=5", 7), ("b=3", 4), ("base", 3)]


def test_route_geometry_follows_the_bends_in_both_directions(spark):
    from terralane.operators.routing import route_geometry

    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 10.0, 0.0), (0, 2, 10.0, 10.0), (0, 3, 30.0, 0.0)], "scene_id long, id long, x double, y double")
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    edges = spark.createDataFrame([(0, 0, 1, line((10, 0), (5, 5), (0, 0))), (0, 1, 2, line((10, 0), (10, 10)))], "scene_id long, u long, v long, polyline array<struct<x:double,y:double>>")
    routes = spark.createDataFrame([(0, "there", [0, 1, 2]), (0, "back", [2, 1, 0]), (0, "stay", [1]), (0, "gap", [0, 1, 3]), (0, "none", None)], "scene_id long, id string, path array<long>")
    got = {r.id: r for r in route_geometry(routes, nodes, edges).collect()}
    there = [(0.0, 0.0), (5.0, 5.0), (10.0, 0.0), (10.0, 10.0)]
    assert set(got) == {"there", "back"}
    assert [(p.x, p.y) for p in got["there"].polyline] == there and [(p.x, p.y) for p in got["back"].polyline] == there[::-1]
    assert abs(got["there"].length - (50**0.5 * 2 + 10)) < 1e-9 and abs(got["back"].detour - got["there"].length / 200**0.5) < 1e-9


def test_tangents_look_back_along_the_chain(spark):
    from terralane.operators.proposals import endpoint_tangents

    # 30 straight to the right before the bend: what lies beyond doesn't count
    nodes, edges = graph(spark, {0: (0, 0), 1: (30, 0), 2: (30, 40), 3: (100, 0), 4: (100, 5)}, [(0, 1), (1, 2), (3, 4)])
    got = {r.id: (round(r.tx, 6), round(r.ty, 6)) for r in endpoint_tangents(nodes, edges).collect()}
    assert got == {0: (-1.0, 0.0), 2: (0.0, 1.0), 3: (0.0, -1.0), 4: (0.0, 1.0)}


def test_probability_without_evidence_is_neutral(spark):
    from terralane.operators.proposals import path_probability

    paths = spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 9.0, 0.0), (7, 1, 2, 0.0, 0.0, 9.0, 0.0)], "scene_id long, a long, b long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(0, x, 0, 0.0 if 3 <= x <= 5 else 1.0) for x in range(10)], "scene_id long, x long, y long, value double")
    got = {r.scene_id: r for r in path_probability(paths, cells).collect()}
    assert (got[7].mean, got[7].samples, got[7].evidence) == (0.5, 0, False)
    assert got[0].samples == 16 and got[0].minimum == 0.0 and got[0].evidence and abs(got[0].longest_low - 4 / 16) < 1e-9


def test_corridor_takes_what_lies_beside_the_line(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0.0, 10.0, 20.0, 10.0)], "scene_id long, u long, v long, x0 double, y0 double, x1 double, y1 double")
    cells = spark.createDataFrame([(0, x, y, 0.8 if y == 14 and x < 10 else 0.0) for x in range(21) for y in range(21)], "scene_id long, x long, y long, value double")
    (r,) = clean.corridor_support(edges, cells).collect()
    assert (r.samples, r.line_gap_samples, r.corridor_gap_samples, r.line_mean) == (21, 21, 11, 0.0) and abs(r.corridor_over_05 - 10 / 21) < 1e-9
