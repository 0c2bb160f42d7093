"""Cases of the third round's findings."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from terralane.functions import geom
from terralane.functions.quantiles import quantiles
from terralane.operators import clean, components, evaluate, features, graph, manifest, proposals, refine, routing, simplify


def test_a_mean_that_equals_the_threshold_is_not_over_it(spark):
    # 0.1 + 0.2 + 0.3 is 0.6 or more by the order
    rows = [(0, 1, 2, v) for v in (0.1, 0.2, 0.3)] + [(0, 2, 1, v) for v in (0.3, 0.2, 0.1)]
    means = graph.aggregate_scores(spark.createDataFrame(rows, "scene_id int, source long, target long, score double").coalesce(1), 0.2)
    assert [r.accepted for r in means.collect()] == [False, False]
    assert graph.undirected_mean(means, 0.2).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_leakage_pairs_meet_once_and_are_not_shuffled(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        x, y = rng.choice([rng.uniform(-3000, 3000), 512.0 * rng.randrange(-5, 5)]), rng.choice([rng.uniform(-3000, 3000), 256.0 * rng.randrange(-9, 9)])
        rows.append((i % 2, i, rng.choice("ab"), x, y, x + rng.choice([0.0, 300.0, 2500.0]), y + rng.choice([0.0, 212.0, 900.0])))
    found = manifest.spatial_leakage(spark.createDataFrame(rows, "frame int, id int, split string, x0 double, y0 double, x1 double, y1 double"))
    want = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]:
                gap = math.hypot(max(a[3] - b[5], b[3] - a[5], 0), max(a[4] - b[6], b[4] - a[6], 0))
                if gap < 512:
                    want.append((a[0], a[1], b[1], round(gap, 6)))
    assert sorted((r.frame, r.id_a, r.id_b, round(r.distance, 6)) for r in found.collect()) == sorted(want)
    assert "id_a" not in "".join(line for line in plan(found).splitlines() if "Exchange" in line or "HashAggregate" in line)


def test_best_tile_does_not_broadcast_tiles_by_the_size_of_their_images(spark):
    images = spark.range(3).select(F.col("id").alias("scene_id"), F.lit(200).alias("width"), F.lit(100).alias("height"))
    points = spark.range(30).select((F.col("id") % 3).alias("scene_id"), "id", (F.col("id") * 6.5).alias("x"), (F.col("id") * 3.0).alias("y"))
    best = features.best_tile(points, features.tile_grid(images, 32, 8), 32)
    assert best.count() == 30
    assert "BroadcastHashJoin" not in plan(best)


@pytest.mark.parametrize("limit", [6, 40, 1 << 20])
def test_triangles_by_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "BLOCK_EDGES", limit)
    rng = random.Random(limit)
    pairs = {s: {tuple(sorted(rng.sample(range(100, 124), 2))) for _ in range(90)} | {(0, i) for i in range(100, 124)} for s in "xy"}
    edges = spark.createDataFrame([(s, *p[:: rng.choice([1, -1])]) for s, ps in pairs.items() for p in ps], "scene_id string, u long, v long")
    want = sorted((s, *t) for s, ps in pairs.items() for t in itertools.combinations([0, *range(100, 124)], 3) if all(p in ps for p in itertools.combinations(t, 2)))
    found = graph.triangles(edges)
    assert sorted(map(tuple, found.collect())) == want
    # pairs of edges at a node are opened in a task: they are neither joined nor shuffled
    # pairs of edges at a node are opened in a task; the only join looks up a scene's blocks
    before = plan(graph.triangles(edges))
    assert before.count("SortMergeJoin") + before.count("BroadcastHashJoin") == 1
    nodes = edges.select("scene_id", F.explode(F.array("u", "v")).alias("id")).distinct()
    count = {(r.scene_id, r.id): r.triangles for r in graph.node_triangles(nodes, edges).collect()}
    assert count == {(s, i): sum(t[0] == s and i in t[1:] for t in want) for s in "xy" for i in [0, *range(100, 124)]}
    chords = {(t[0], *p) for t in want for p in itertools.combinations(t[1:], 2)}
    assert sorted(map(tuple, graph.chord_edges(edges).collect())) == sorted(chords)


def test_directions_are_rows_not_arrays(spark):
    # one node with edges every 10 degrees but for one gap of 200, and one with two opposite edges
    star = [(0, i, math.cos(math.radians(10.0 * i)), math.sin(math.radians(10.0 * i))) for i in range(1, 17)]
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), *star, (0, 50, 9.0, 0.0), (0, 51, 8.0, 0.0), (0, 52, 10.0, 0.0), (0, 99, 0.0, 9.0)], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, 0, i) for i in range(1, 17)] + [(0, 50, 51), (0, 50, 52)], "scene_id int, u long, v long")
    roles = graph.node_roles(nodes, edges)
    got = {r.id: (r.groups, r.role) for r in roles.collect()}
    assert (got[0], got[50], got[99], got[1]) == ((1, "endpoint"), (2, "corridor"), (0, "isolated"), (1, "endpoint"))
    assert "collect_list" not in plan(roles)


def test_crossings_meet_once_and_are_not_shuffled(spark):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(0, i, rng.uniform(-150, 150), rng.uniform(-150, 150)) for i in range(24)], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, *sorted(rng.sample(range(24), 2))) for _ in range(40)], "scene_id int, u long, v long")
    found = graph.crossings(nodes, edges, side=40.0)
    before = plan(found)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == set(map(tuple, graph.crossings(nodes, edges, side=1000.0).collect())) and rows
    assert "HashAggregate" not in before.split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]


def test_ways_are_measured_before_their_second_edge_is_looked_up(spark):
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.5), (0, 2, 10.0, 0.0), (0, 3, 5.0, 4.0)], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 0, 3), (0, 2, 3)], "scene_id int, u long, v long")
    chords = clean.redundant_chords(nodes, edges)
    before = plan(chords)
    assert [tuple(r) for r in chords.collect()] == [(0, 0, 2, 1)]
    semi = next(line for line in before.splitlines() if "LeftSemi" in line)
    assert "ACOS" in before[before.index(semi) :]


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_components_are_contracted_in_their_scenes_before_any_shuffle(spark, monkeypatch, held):
    monkeypatch.setattr(components, "HELD_EDGES", held)
    rng = random.Random(held)
    pairs = [(s, i % 2, *rng.sample(range(40), 2)) for s in "xy" for i in range(45)] + [("x", 0, 7, 7)]
    seen = []
    own = components.contracted
    monkeypatch.setattr(components, "contracted", lambda e, by: seen.append(plan(e)) or own(e, by))
    found = components.connected_components(spark.createDataFrame(pairs, "s string, k int, u long, v long"), by=["s", "k"])
    least = {}
    for s, k, u, v in pairs:
        if u != v:
            least.setdefault((s, k, u), u), least.setdefault((s, k, v), v)
    for _ in range(40):
        for s, k, u, v in pairs:
            if u != v:
                least[s, k, u] = least[s, k, v] = min(least[s, k, u], least[s, k, v])
    assert sorted(map(tuple, found.collect())) == sorted((*n, c) for n, c in least.items())
    assert len(seen) == 1 and "Exchange" not in seen[0]


def test_edges_between_ends_of_chains_take_no_part_in_rounds(spark, monkeypatch):
    # a full graph of six nodes with a tail of three edges, a ring of four and a line of one edge
    full = list(itertools.combinations(range(6), 2))
    pairs = full + [(5, 6), (6, 7), (7, 8), (20, 21), (21, 22), (22, 23), (20, 23), (30, 31)]
    ids = sorted({i for p in pairs for i in p})
    nodes = spark.createDataFrame([(0, i, float(i), 0.0) for i in ids], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, *p, 1.0) for p in pairs], "scene_id int, u long, v long, length double")
    rows, own = {}, clean.stored
    monkeypatch.setattr(clean, "stored", lambda df, name="step": rows.setdefault(name, []).append(df.count()) or own(df, name))
    got = sorted((r.path, r.length, r.closed) for r in clean.chains(nodes, edges).collect())
    assert got == sorted([([*p], 1.0, False) for p in full] + [([5, 6, 7, 8], 3.0, False), ([20, 21, 22, 23, 20], 4.0, True), ([30, 31], 1.0, False)])
    assert max(rows["ranks"]) <= 2 * 7


def test_nodes_that_stay_bent_without_any_one_neighbour(spark):
    rng = random.Random(2)
    far = [(0, n, 100 + k, math.cos(a), math.sin(a)) for n in range(30) for k, a in enumerate(rng.uniform(-3.1, 3.1) for _ in range(rng.randrange(1, 6)))]
    got = {r.id for r in refine.clear_nodes(spark.createDataFrame(far, "scene_id int, id long, other long, dx double, dy double"), 35.0).collect()}

    def bent(p, q):
        return 35 < abs((math.degrees(math.atan2(p[4], p[3]) - math.atan2(q[4], q[3])) + 180) % 360 - 180) < 145

    want = set()
    for n in range(30):
        w = [f for f in far if f[1] == n]
        if all(any(bent(p, q) for p in w for q in w if x not in (p, q)) for x in w):
            want.add(n)
    assert got == want and want


def test_routes_keep_the_tables_of_two_rounds(spark, monkeypatch):
    n = 12
    nodes = spark.createDataFrame([(0, i, 10.0 * i, 0.0) for i in range(n)], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, i, i + 1, 10.0) for i in range(n - 1)], "scene_id int, u long, v long, length double")
    at = routing.attach(spark.createDataFrame([(0, 1, 2.0, 0.0, 108.0, 0.0)], "scene_id int, id long, sx double, sy double, gx double, gy double"), nodes, edges, 5.0)
    held, most, own, drop = set(), [], routing.stored, routing.free

    def stored(df, name="step"):
        out = own(df, name)
        if name == "known":
            held.add(out.stored_at)
            most.append(len(held))
        return out

    def free(*tables):
        held.difference_update(t.stored_at for t in tables)
        drop(*tables)

    monkeypatch.setattr(routing, "stored", stored)
    monkeypatch.setattr(routing, "free", free)
    row = routing.routes(at, edges).collect()[0]
    assert row.path == list(range(1, n - 1)) and abs(row.length - 106.0) < 1e-9
    assert max(most) == 2


def test_greedy_keeps_decided_rows_only(spark, monkeypatch):
    items = spark.createDataFrame([(0, k, k, k + 1, True) for k in range(8)], "scene_id int, key long, a long, b long, ok boolean")
    left, own, drop = set(), refine.stored, refine.free
    monkeypatch.setattr(refine, "stored", lambda df, name="step": (out := own(df, name), left.add((name, out.stored_at)))[0])
    monkeypatch.setattr(refine, "free", lambda *t: (drop(*t), [left.discard(x) for x in list(left) if x[1] in {d.stored_at for d in t}]))
    got = {r.key: r.accepted for r in refine.greedy(items).collect()}
    assert got == {k: k % 2 == 0 for k in range(8)}
    assert not [n for n, _ in left if n == "round"]


def test_branches_of_many_directions_and_bounded_ways(spark):
    star = [(0, i, math.cos(math.radians(6.0 * i)), math.sin(math.radians(6.0 * i))) for i in range(1, 60) if i not in (20, 21, 22, 40, 41, 42)]
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), *star], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, 0, r[1]) for r in star], "scene_id int, u long, v long")
    hub = next(r for r in simplify.branches(nodes, edges).collect() if r.id == 0)
    # the gaps are those left out: 114 to 138 and 234 to 258 degrees; 354 to 6 is no gap
    assert (hub.degree, hub.branch_count) == (len(star), 2)
    assert [m.branch for m in hub.members] == sorted(m.branch for m in hub.members)
    assert "slice" not in plan(simplify.branches(nodes, edges))
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 5.0, 0.5), (0, 2, 10.0, 0.0), (0, 3, 5.0, 40.0)], "scene_id int, id long, x double, y double")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 0, 3), (0, 2, 3), (0, 1, 3)], "scene_id int, u long, v long")
    wanted = edges.where("u = 0 and v = 2")
    ways = lambda most: sorted(r.path for r in simplify.alternatives(nodes, edges, wanted, 3, most).collect())
    assert ways(1.1) == [[0, 1, 2]] and ways(None) == [[0, 1, 2], [0, 1, 3, 2], [0, 3, 1, 2], [0, 3, 2]]


@pytest.mark.parametrize("seed", range(3))
def test_nearest_segments_are_found_in_blocks(spark, seed):
    rng = random.Random(seed)
    spot = lambda: (rng.choice([rng.uniform(-60, 60), 12.0 * rng.randrange(-5, 6)]), rng.uniform(-60, 60))
    lines = []
    for i in range(40):
        a = spot()
        b = rng.choice([spot(), (a[0] + rng.uniform(-2, 2), a[1]), a])
        lines.append((i % 2, *a, *b))
    points = [(i % 2, i, *rng.choice([spot(), (rng.uniform(-400, 400), 0.0), lines[i % 40][1:3]])) for i in range(300)] + [(0, 999, None, 1.0)]
    segments = spark.createDataFrame(lines, "scene_id int, x0 double, y0 double, x1 double, y1 double")
    found = evaluate.nearest_distance(spark.createDataFrame(points, "scene_id int, id long, x double, y double"), segments, 24.0, ["id"])

    def distance(px, py, x0, y0, x1, y1):
        l2 = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = max(0.0, min(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / l2)) if l2 else 0.0
        return math.hypot(px - x0 - t * (x1 - x0), py - y0 - t * (y1 - y0))

    expected = {}
    for s, i, x, y in points:
        d = min((distance(x, y, *q[1:]) for q in lines if q[0] == s), default=99.0) if x is not None else 99.0
        expected[i] = d if d <= 24 else None
    got = {r.id: r.distance for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(got[i] == pytest.approx(expected[i], abs=1e-9) if expected[i] is not None else got[i] is None for i in got)
    # pairs of a point and a segment stay in their task
    assert "Join" not in plan(found)


def test_lines_of_the_truth_are_labelled_without_samples(spark):
    rows = [(0, 1, 2, 0.0, 0.0, 50.0, 0.0), (0, 1, 3, 0.0, 5.0, 50.0, 5.0), (0, 4, 5, 0.0, 300.0, 50.0, 300.0), (0, 6, 7, 0.0, 3.0, 50.0, 3.0)]
    lines = spark.createDataFrame(rows, "scene_id int, u long, v long, x0 double, y0 double, x1 double, y1 double")
    # an edge of the truth that lies elsewhere than the line of the same name says nothing about it
    truth = lines.where("u = 1 and v = 2").unionByName(lines.where("u = 6").selectExpr("scene_id", "u", "v", "x0", "y0 + 900 AS y0", "x1", "y1 + 900 AS y1"))
    got = {(r.u, r.v): (r.overlap, r.mean, r.p95, r.label) for r in evaluate.label_lines(lines, truth, 10.0, ["u", "v"], 4.0, 24.0).collect()}
    assert got == {(1, 2): (1.0, 0.0, 0.0, 1), (1, 3): (0.0, 5.0, 5.0, 0), (4, 5): (0.0, 24.0, 24.0, 0), (6, 7): (1.0, 3.0, 3.0, 1)}


@pytest.mark.parametrize("name", ["e4_sample_spacing", "i4_sample_lines", "i3_inside_region"])
def test_edges_are_sampled_where_they_are_found(spark, name):
    import __spark_entry__

    rows = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")
    # the pairs of points, and the boxes of regions, which are broadcast
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join Inner") == (2 if name == "i3_inside_region" else 1)


def test_a_long_line_is_sliced_in_one_walk(spark):
    import time

    line = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(20000)), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y"))).alias("poly"))
    full = geom.arc_length(F.col("poly"))
    start = time.time()
    part = line.select(geom.sliced(F.col("poly"), full * 0.25, full * 0.75).alias("p")).collect()[0].p
    assert [p.x for p in part] == [5000.0, *(float(i) for i in range(5001, 15000)), 15000.0]
    assert time.time() - start < 30
    short = spark.createDataFrame([(0.0, 0.0), (0.5, 2.0), (1.0, 1.0), (0.0, 9.0), (2.0, 2.5)], "a double, b double").crossJoin(spark.range(1).select(F.expr("array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 2D AS y))").alias("poly")))
    got = {(r.a, r.b): [tuple(p) for p in r.p] for r in short.select("a", "b", geom.sliced(F.col("poly"), F.col("a"), F.col("b")).alias("p")).collect()}
    assert got == {
        (0.0, 0.0): [(0.0, 0.0), (0.0, 0.0)], (0.5, 2.0): [(0.5, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 1.0)], (1.0, 1.0): [(1.0, 0.0), (1.0, 0.0)],
        (0.0, 9.0): [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0), (1.0, 2.0), (1.0, 2.0)], (2.0, 2.5): [(1.0, 1.0), (1.0, 1.5)],
    }


def test_quantiles_of_groups_are_those_of_percentile(spark):
    rng = random.Random(4)
    draws = [lambda: rng.gauss(0, 50), lambda: float(rng.randrange(3)), lambda: rng.choice([0.0, -0.0, 1e-9, float("inf"), -1e300]), lambda: rng.choice([None, 7.25]), lambda: rng.choice([float("nan"), 1.0])]
    rows = [(rng.choice([None, 1, 2]), k, draw()) for k, draw in enumerate(draws) for _ in range(rng.randrange(1, 400))] + [(3, 9, None), (3, 10, 5.0)]
    df = spark.createDataFrame(rows, "a int, b int, v double").repartition(5)
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    key = lambda r: (str(r.a), r.b)
    text = lambda v: str(v + 0.0) if v is not None else None
    got = {key(r): [text(r[c]) for c in shares] for r in quantiles(df, ["a", "b"], "v", shares).collect()}
    expected = df.where("v is not null").groupBy("a", "b").agg(*(F.percentile("v", F.lit(q)).alias(c) for c, q in shares.items())).collect()
    assert got == {key(r): [text(r[c]) for c in shares] for r in expected}


def test_profiles_of_lengths_hold_no_group_of_lengths(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(4)], "scene_id int, id long")
    edges = spark.createDataFrame([(0, 0, 1, 10.0), (0, 1, 2, 40.0), (0, 2, 3, 20.0)], "scene_id int, u long, v long, length double")
    profile = graph.length_profile(nodes, edges)
    stats = proposals.proposal_stats(edges.selectExpr("CAST(null AS string) AS kind", "'x' AS status", "length"), "kind", ["length"])
    assert all("percentile" not in plan(df) for df in (profile, stats))
    assert profile.collect()[0].p50 == 20.0
    assert stats.collect()[0][2:] == ("length", 3, 10.0, 12.0, 20.0, 36.0, 40.0, pytest.approx(70 / 3))
