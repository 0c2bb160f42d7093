"""Least-cost paths over rasters for many pairs of places at once: a wavefront that moves from tile to tile."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geom
from ..functions.spatial import near_points, near_segments
from ..plans.scratch import free, stored
from .graph import SCENE, component_inventory, components, degrees, with_ends

#: Cells of a tile's side. A round moves all fronts through whole tiles, so rounds follow the tiles that a path crosses.
TILE = 64
#: Tiles that one numpy step takes together.
TOGETHER = 32
#: The eight moves as (dy, dx), in the order in which equal ways are preferred.
MOVES = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)]
PAIR = [SCENE, "id"]
PLACE = [*PAIR, "ty", "tx"]


def raster_tiles(cells: DataFrame, value: str = "cost", tile: int = TILE) -> DataFrame:
    """(scene, ty, tx, costs): the cells (scene, x, y, value) of square tiles with one cell of their surroundings, as float64 rows.

    Cells that are missing, null or not above 0 are infinite: no path crosses them. A tile is bounded by its side.
    """
    y, x = F.col("y").cast("long"), F.col("x").cast("long")
    # a cell on a tile's border stands in its neighbours' surroundings too
    near = lambda c: F.array_distinct(F.array(*(F.floor((c + d) / tile).cast("long") for d in (-1, 0, 1))))
    c = cells.select(SCENE, y.alias("y"), x.alias("x"), F.col(value).cast("double").alias("v")).where("v > 0")
    c = c.withColumn("ty", F.explode(near(F.col("y")))).withColumn("tx", F.explode(near(F.col("x"))))
    at = ((F.col("y") - F.col("ty") * tile + 1) * (tile + 2) + F.col("x") - F.col("tx") * tile + 1).cast("int")
    own = (F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))
    parts = c.groupBy(SCENE, "ty", "tx").agg(F.collect_list(F.struct(at.alias("at"), "v")).alias("c"), F.bool_or(own).alias("own")).where("own")

    def dense(batches):
        for batch in batches:
            rows = []
            for cells in batch.column(3):
                a = np.full((tile + 2) ** 2, np.inf)
                a[cells.values.field(0).to_numpy()] = cells.values.field(1).to_numpy()
                rows.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, pa.binary())], [SCENE, "ty", "tx", "costs"])

    kind = cells.schema[SCENE].dataType.simpleString()
    return parts.select(SCENE, "ty", "tx", "c").mapInArrow(dense, f"{SCENE} {kind}, ty long, tx long, costs binary")


class Front:
    """What a task does with one tile of one pair: masks, relaxation inside the tile, and the walk back."""

    def __init__(self, tile: int, corners: bool):
        self.tile, self.corners = tile, corners
        self.own = slice(1, tile + 1)

    def shifted(self, a: np.ndarray, dy: int, dx: int) -> np.ndarray:
        return a[:, 1 + dy : self.tile + 1 + dy, 1 + dx : self.tile + 1 + dx]

    def windowed(self, costs: list[bytes], ty: np.ndarray, tx: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Costs (k, tile + 2, tile + 2), infinite outside each pair's window (x0, y0, x1, y1)."""
        c = np.frombuffer(b"".join(costs)).reshape(len(costs), self.tile + 2, self.tile + 2).copy()
        at = np.arange(-1, self.tile + 1)
        y, x = ty[:, None] * self.tile + at, tx[:, None] * self.tile + at
        c[~((y >= box[:, 1, None]) & (y <= box[:, 3, None])), :] = np.inf
        c.transpose(0, 2, 1)[~((x >= box[:, 0, None]) & (x <= box[:, 2, None])), :] = np.inf
        return c

    def disks(self, ty: np.ndarray, tx: np.ndarray, px: np.ndarray, py: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells of the tiles, surroundings included, lie within the radius of a place."""
        at = np.arange(-1, self.tile + 1)
        y, x = ty[:, None] * self.tile + at - py[:, None], tx[:, None] * self.tile + at - px[:, None]
        return np.sqrt(y[:, :, None] ** 2 + x[:, None, :] ** 2) <= radius[:, None, None]

    def weights(self, c: np.ndarray) -> list[np.ndarray]:
        """For each move the cost of stepping into a cell from the neighbour that lies in that direction."""
        out, here = [], self.shifted(c, 0, 0)
        with np.errstate(invalid="ignore"):
            for dy, dx in MOVES:
                w = np.hypot(dy, dx) * (self.shifted(c, dy, dx) + here) * 0.5
                if dy and dx and not self.corners:  # both cells beside a diagonal step must be free
                    w = np.where(np.isfinite(self.shifted(c, dy, 0)) & np.isfinite(self.shifted(c, 0, dx)), w, np.inf)
                out.append(w)
        return out

    def relax(self, d: np.ndarray, w: list[np.ndarray]) -> None:
        """Least distances of the tiles' own cells from each other and from their surroundings, in place."""
        busy = np.arange(len(d))
        while len(busy):
            part = d[busy]
            best = part[:, self.own, self.own].copy()
            for (dy, dx), x in zip(MOVES, w):
                np.minimum(best, self.shifted(part, dy, dx) + x[busy], out=best)
            moved = (best < part[:, self.own, self.own]).any(axis=(1, 2))
            part[:, self.own, self.own] = best
            d[busy] = part
            busy = busy[moved]

    def sent(self, ty: int, tx: int, before: np.ndarray, after: np.ndarray) -> list[dict]:
        """For each neighbouring tile the distances on this tile's border that have become less: their places there and values."""
        n, out = self.tile, []
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if not dy and not dx:
                    continue
                rows = slice(1, 2) if dy < 0 else slice(n, n + 1) if dy else self.own
                cols = slice(1, 2) if dx < 0 else slice(n, n + 1) if dx else self.own
                y, x = np.nonzero(after[rows, cols] < before[rows, cols])
                if len(y):
                    y, x = y + rows.start, x + cols.start
                    out.append({"ty": ty + dy, "tx": tx + dx, "at": ((y - dy * n) * (n + 2) + x - dx * n).tolist(), "d": after[y, x].tolist()})
        return out

    def back(self, d: np.ndarray, w: list[np.ndarray], starts: np.ndarray, y: int, x: int) -> tuple[list[tuple[int, int]], bool]:
        """Places in the tile from (y, x) back to a start (True), or to the first one in the surroundings (False), which comes last."""
        walk = [(y, x)]
        while not starts[y, x]:
            if not (1 <= y <= self.tile and 1 <= x <= self.tile):
                return walk, False
            ways = [d[y + dy, x + dx] + v[y - 1, x - 1] for (dy, dx), v in zip(MOVES, w)]
            dy, dx = MOVES[int(np.argmin(ways))]
            y, x = y + dy, x + dx
            walk.append((y, x))
        return walk, True


WINDOW = ["sx", "sy", "gx", "gy", "radius", "bx0", "by0", "bx1", "by1"]


def numbers(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]


def least_cost_paths(pairs: DataFrame, cells: DataFrame, margin: float | None = 64.0, radius: float = 3.0, corners: bool = True, value: str = "cost", floor: float = 1.0, tile: int = TILE) -> DataFrame:
    """(scene, id, found, cost, path array<struct<x, y>>) of pairs (scene, id, sx, sy, gx, gy): the cheapest eight-neighbour path of each.

    It leads from a cell within `radius` of the start to one within `radius` of the goal; a step costs its length times the mean of both cells'
    values. Only cells of the box of both places, widened by the margin (None: the whole raster), are entered. Cells that are missing or
    not above 0 are blocked; without `corners` a diagonal step also needs both cells beside it. No cell may cost less than `floor`: the front of a pair leaves
    out what can't beat its best way to the goal any more. Of equally cheap ends the one of least (y, x) counts, then the first move of
    MOVES. ids are unique in a scene; pairs with a null place aren't found.

    All pairs advance together. A round takes the tiles whose surroundings have changed, relaxes them in numpy, and sends the
    distances on their borders to the tiles beside them; rounds end when nothing gets cheaper. Then all paths are walked back, a tile a round.
    """
    front = Front(tile, corners)
    tiles = stored(raster_tiles(cells, value, tile), "tiles")
    scene = pairs.schema[SCENE].dataType.simpleString()
    key = pairs.schema["id"].dataType.simpleString()
    ids = f"{SCENE} {scene}, id {key}, ty long, tx long"
    low = lambda a, b: F.floor(F.least(a, b) - margin).cast("double")
    high = lambda a, b: F.ceil(F.greatest(a, b) + margin).cast("double")
    own = pairs.select(*PAIR, *(F.col(c).cast("double").alias(c) for c in ("sx", "sy", "gx", "gy")), F.lit(float(radius)).alias("radius")).where("sx + sy + gx + gy is not null")
    if margin is None:
        box = tiles.groupBy(SCENE).agg(*(f((F.col(t) + more) * tile).cast("double").alias(b) for b, f, t, more in (("bx0", F.min, "tx", 0), ("by0", F.min, "ty", 0), ("bx1", F.max, "tx", 1), ("by1", F.max, "ty", 1))))
        own = own.join(F.broadcast(box), SCENE)  # one row a scene with tiles; only pairs' scenes stay
    else:
        own = own.withColumns({"bx0": low("sx", "gx"), "by0": low("sy", "gy"), "bx1": high("sx", "gx"), "by1": high("sy", "gy")})
    own = stored(own, "pairs")
    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    near = lambda c: F.sequence(F.floor((F.col(c) - F.col("radius")) / tile).cast("long"), F.floor((F.col(c) + F.col("radius")) / tile).cast("long"))
    inbox = own.select(*PAIR, F.explode(near("sy")).alias("ty"), "sx", "radius").select(*PAIR, "ty", F.explode(near("sx")).alias("tx")).withColumn("at", F.array().cast("array<int>")).withColumn("d", F.array().cast("array<double>"))
    state = None
    best = stored(own.select(*PAIR, F.lit(None).cast("struct<d:double,y:bigint,x:bigint>").alias("goal")).limit(0), "best")
    out_type = "array<struct<ty: bigint, tx: bigint, at: array<int>, d: array<double>>>"

    def step(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                yield one_step(front, batch.slice(k, TOGETHER))

    while True:
        inbox = stored(inbox, "inbox")
        if inbox.isEmpty():
            break
        known = inbox.withColumn("dist", F.lit(None).cast("binary")) if state is None else inbox.join(state, PLACE, "left")
        rows = known.join(own, PAIR).join(tiles, [SCENE, "ty", "tx"]).select(*PLACE, "at", "d", "dist", *WINDOW, "costs")
        done = stored(rows.mapInArrow(step, f"{ids}, dist binary, goal struct<d: double, y: bigint, x: bigint>, sent {out_type}"), "step")
        old = state
        now = done.select(*PLACE, "dist")
        state = stored(now if old is None else now.unionByName(old.join(inbox.select(*PLACE), PLACE, "left_anti")), "distances")
        least = F.min("goal").alias("goal")
        new_best = stored(best.unionByName(done.select(*PAIR, "goal").where("goal is not null")).groupBy(*PAIR).agg(least), "best")
        box = F.sqrt((F.col("gx") - F.col("cx")) ** 2 + (F.col("gy") - F.col("cy")) ** 2)
        sent = done.select(*PAIR, F.explode("sent").alias("m")).select(*PAIR, "m.*").join(own.select(*PAIR, "gx", "gy", "radius"), PAIR).join(new_best, PAIR, "left")
        # the nearest place of the tile to the goal bounds the rest of the way
        sent = sent.withColumn("cx", F.greatest(F.col("tx") * tile - 1, F.least(F.col("gx"), (F.col("tx") + 1) * tile))).withColumn("cy", F.greatest(F.col("ty") * tile - 1, F.least(F.col("gy"), (F.col("ty") + 1) * tile)))
        rest = F.greatest(F.lit(0.0), box - F.col("radius")) * floor
        sent = sent.where(F.col("goal").isNull() | (F.array_min("d") + rest <= F.col("goal.d") + 1e-9))
        before = inbox
        inbox = stored(sent.groupBy(*PLACE).agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("d")).alias("d")), "sent")
        free(before, done, best, *([old] if old is not None else []))
        best = new_best
    if state is None:  # no pairs at all
        state = inbox.select(*PLACE, F.lit(None).cast("binary").alias("dist"))

    def walk(batches):
        for batch in batches:
            yield one_walk(front, batch, ids)

    walker = best.select(*PAIR, F.floor(F.col("goal.y") / tile).cast("long").alias("ty"), F.floor(F.col("goal.x") / tile).cast("long").alias("tx"), F.col("goal.y").alias("y"), F.col("goal.x").alias("x"))
    parts, number = [], 0
    while True:
        walker = stored(walker, "walker")
        if walker.isEmpty():
            break
        rows = walker.join(state, PLACE).join(own, PAIR).join(tiles, [SCENE, "ty", "tx"]).select(*PLACE, "y", "x", "dist", *WINDOW, "costs")
        number += 1
        part = stored(rows.mapInArrow(walk, f"{SCENE} {scene}, id {key}, cells array<struct<x: bigint, y: bigint>>, ends boolean"), "part")
        parts.append(part.select(*PAIR, F.lit(-number).alias("k"), "cells", "ends"))
        # the last place of a part lies in the next tile and begins the next part
        last = F.element_at("cells", -1)
        walker = part.where("not ends").select(*PAIR, F.floor(last["y"] / tile).cast("long").alias("ty"), F.floor(last["x"] / tile).cast("long").alias("tx"), last["y"].alias("y"), last["x"].alias("x"))
    every = parts[0] if parts else None
    for p in parts[1:]:
        every = every.unionByName(p)
    found = best.select(*PAIR, F.col("goal.d").alias("cost"))
    if every is None:
        path = found.select(*PAIR, F.lit(None).cast("array<struct<x: bigint, y: bigint>>").alias("path"))
    else:
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", F.reverse(F.when(F.col("ends"), F.col("cells")).otherwise(F.slice("cells", 1, F.size("cells") - 1))).alias("cells")))), lambda s: s["cells"]))
        path = every.groupBy(*PAIR).agg(whole.alias("path"))
    result = pairs.select(*PAIR).join(found, PAIR, "left").join(path, PAIR, "left")
    return result.select(*PAIR, F.col("cost").isNotNull().alias("found"), "cost", "path")


def one_step(front: Front, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Relax the tiles of a batch with what their neighbours have sent."""
    n = front.tile + 2
    ty, tx = numbers(batch, ("ty", "tx"))
    sx, sy, gx, gy, radius, *box = numbers(batch, WINDOW)
    c = front.windowed(batch.column("costs").to_pylist(), ty, tx, np.stack(box, axis=1))
    d = np.full(c.shape, np.inf)
    for i, (dist, at, value) in enumerate(zip(batch.column("dist").to_pylist(), batch.column("at").to_pylist(), batch.column("d").to_pylist())):
        if dist is not None:
            d[i] = np.frombuffer(dist).reshape(n, n)
        if at:
            np.minimum.at(d[i].reshape(-1), np.array(at), np.array(value))
    before = d.copy()
    d[front.disks(ty, tx, sx, sy, radius) & np.isfinite(c)] = 0.0
    front.relax(d, front.weights(c))
    goals = front.disks(ty, tx, gx, gy, radius)[:, front.own, front.own]
    ends, sent = [], []
    for i in range(len(d)):
        inner = np.where(goals[i], d[i][front.own, front.own], np.inf)
        k = int(np.argmin(inner))  # the first of equal ones: least y, then x
        y, x = divmod(k, front.tile)
        ends.append({"d": float(inner[y, x]), "y": int(ty[i]) * front.tile + y, "x": int(tx[i]) * front.tile + x} if np.isfinite(inner[y, x]) else None)
        sent.append(front.sent(int(ty[i]), int(tx[i]), before[i], d[i]))
    kinds = pa.struct([("d", pa.float64()), ("y", pa.int64()), ("x", pa.int64())])
    message = pa.list_(pa.struct([("ty", pa.int64()), ("tx", pa.int64()), ("at", pa.list_(pa.int32())), ("d", pa.list_(pa.float64()))]))
    return pa.RecordBatch.from_arrays([*(batch.column(p) for p in PLACE), pa.array([x.tobytes() for x in d], pa.binary()), pa.array(ends, kinds), pa.array(sent, message)], [*PLACE, "dist", "goal", "sent"])


def one_walk(front: Front, batch: pa.RecordBatch, ids: str) -> pa.RecordBatch:
    """Walk the paths of a batch back through one tile each."""
    n, cells, ends = front.tile + 2, [], []
    if batch.num_rows:
        ty, tx = numbers(batch, ("ty", "tx"))
        sx, sy, _, _, radius, *box = numbers(batch, WINDOW)
    for i in range(batch.num_rows):
        one = slice(i, i + 1)
        c = front.windowed([batch.column("costs")[i].as_py()], ty[one], tx[one], np.stack([b[one] for b in box], axis=1))
        starts = (front.disks(ty[one], tx[one], sx[one], sy[one], radius[one]) & np.isfinite(c))[0]
        oy, ox = int(ty[i]) * front.tile - 1, int(tx[i]) * front.tile - 1
        d = np.frombuffer(batch.column("dist")[i].as_py()).reshape(n, n)
        walk, end = front.back(d, [w[0] for w in front.weights(c)], starts, batch.column("y")[i].as_py() - oy, batch.column("x")[i].as_py() - ox)
        cells.append([{"x": x + ox, "y": y + oy} for y, x in walk])
        ends.append(end)
    kinds = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column(SCENE), batch.column("id"), pa.array(cells, kinds), pa.array(ends, pa.bool_())], [SCENE, "id", "cells", "ends"])


def grid_routes(pairs: DataFrame, cells: DataFrame, threshold: float = 0.5, value: str = "value", tile: int = TILE) -> DataFrame:
    """(scene, id, found, length, path, reason) of pairs of cells: shortest eight-neighbour routes over cells with value >= threshold, corners not cut.

    reason: endpoint_out_of_bounds where an end has no cell, endpoint_blocked where one isn't free, else disconnected; null for a route.
    """
    free_cells = cells.where(F.col(value) >= threshold).select(SCENE, "x", "y", F.lit(1.0).alias("cost"))
    out = least_cost_paths(pairs, free_cells, None, 0.0, False, tile=tile)
    at = cells.select(SCENE, F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), (F.col(value) >= threshold).alias("free"))
    known = pairs.select(*PAIR, *(F.col(c).cast("double").alias(c) for c in ("sx", "sy", "gx", "gy")))
    for e in "sg":
        known = known.join(at.select(SCENE, F.col("px").alias(f"{e}x"), F.col("py").alias(f"{e}y"), F.col("free").alias(f"{e}free")), [SCENE, f"{e}x", f"{e}y"], "left")
    reason = F.when(F.col("found"), F.lit(None)).when(F.col("sfree").isNull() | F.col("gfree").isNull(), "endpoint_out_of_bounds").when(~(F.col("sfree") & F.col("gfree")), "endpoint_blocked").otherwise("disconnected")
    return out.join(known.select(*PAIR, "sfree", "gfree"), PAIR).select(*PAIR, "found", F.col("cost").alias("length"), "path", reason.alias("reason"))


def seed_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float = 250.0, most: int = 6) -> DataFrame:
    """Places between which corridors of component pairs (scene, a, b) are sought: the `most` nearest of each pair, from 2 to radius apart.

    A component's seeds are its endpoints, or the nodes at its four extremes where it has none. They meet the other component's seeds, and its nearest
    edge (then of least u, v) at the nearest place. Of places that agree to one decimal the nearest pair stays; then node pairs go before edges.
    Result: scene, a, b, rank, source_component, source, target_component, target (null for an edge), u, v, t, sx, sy, gx, gy, distance.
    """
    comp = components(nodes, edges)
    ends = degrees(nodes, edges).where("endpoint").select(SCENE, "id").join(comp, [SCENE, "id"])
    extremes = component_inventory(nodes, edges).join(ends.select(SCENE, "component").distinct(), [SCENE, "component"], "left_anti")
    extremes = extremes.select(SCENE, F.explode(F.array_distinct(F.array("left", "right", "top", "bottom"))).alias("id"), "component")
    seeds = stored(ends.unionByName(extremes).join(nodes.select(SCENE, "id", "x", "y"), [SCENE, "id"]), "seeds")
    both = lambda p, q: [F.least(p, q).alias("a"), F.greatest(p, q).alias("b")]
    side = lambda s: seeds.select(SCENE, F.col("id").alias(f"id_{s}"), F.col("component").alias(f"c_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    nn = near_points(seeds, seeds, radius, SCENE).join(side("a"), [SCENE, "id_a"]).join(side("b"), [SCENE, "id_b"]).where("c_a < c_b")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    nn = nn.select(SCENE, *both("c_a", "c_b"), "distance", F.lit(0).alias("kind"), F.col("c_a").alias("source_component"), F.col("id_a").alias("source"), F.col("c_b").alias("target_component"), F.col("id_b").alias("target"), *none("long", "u", "v"), *none("double", "t"), F.col("x_a").alias("sx"), F.col("y_a").alias("sy"), F.col("x_b").alias("gx"), F.col("y_b").alias("gy"))
    e = with_ends(nodes, edges.select(SCENE, "u", "v")).join(comp.select(SCENE, F.col("id").alias("u"), F.col("component").alias("other")), [SCENE, "u"])
    hit = near_segments(seeds, e, radius, SCENE).where("component <> other")
    place = lambda c: F.col(f"{c}0") + F.col("t") * (F.col(f"{c}1") - F.col(f"{c}0"))
    hit = hit.groupBy(SCENE, "id", "component", "x", "y", "other").agg(F.min(F.struct(F.round("distance", 9).alias("r"), "u", "v", "t", "distance", place("x").alias("gx"), place("y").alias("gy"))).alias("m"))
    ne = hit.select(SCENE, *both("component", "other"), "m.distance", F.lit(1).alias("kind"), F.col("component").alias("source_component"), F.col("id").alias("source"), F.col("other").alias("target_component"), *none("long", "target"), "m.u", "m.v", "m.t", F.col("x").alias("sx"), F.col("y").alias("sy"), "m.gx", "m.gy")
    rows = nn.unionByName(ne).join(pairs.select(SCENE, "a", "b"), [SCENE, "a", "b"], "left_semi")
    rest = ["kind", "source_component", "source", "target_component", "target", "u", "v", "t", "sx", "sy", "gx", "gy", "distance"]
    best = F.min(F.struct(F.round("distance", 9).alias("r"), *rest)).alias("m")
    one = rows.groupBy(SCENE, "a", "b", *(F.bround(c, 1).alias(f"k{c}") for c in ("sx", "sy", "gx", "gy"))).agg(best).select(SCENE, "a", "b", "m.*")
    rank = F.row_number().over(Window.partitionBy(SCENE, "a", "b").orderBy("r", "kind", "source_component", "source", "target", "u", "v"))
    one = one.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("distance") >= 2) & (F.col("distance") <= radius))
    return one.select(SCENE, "a", "b", "rank", *rest[1:])


def polyline_segments(paths: DataFrame) -> DataFrame:
    """(scene, id, k, x0, y0, x1, y1, before): the segments of polylines and the arc length before each."""
    n = F.size("polyline")
    seg = lambda i: F.struct(i.alias("k"), F.get("polyline", i - 1)["x"].cast("double").alias("x0"), F.get("polyline", i - 1)["y"].cast("double").alias("y0"), F.get("polyline", i)["x"].cast("double").alias("x1"), F.get("polyline", i)["y"].cast("double").alias("y1"))
    s = paths.where(n > 1).select(SCENE, "id", F.explode(F.transform(F.sequence(F.lit(1), n - 1), seg)).alias("s")).select(SCENE, "id", "s.*")
    w = Window.partitionBy(SCENE, "id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("before", F.coalesce(F.sum(geom.distance("x0", "y0", "x1", "y1")).over(w), F.lit(0.0)))


def polyline_crossings(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scene, id, component, u, v, x, y, position): where polylines (scene, id, polyline) meet edges; position is the arc length up to there.

    Of meetings with one component at one place (4 decimals) the first one of least edge stays. Parallel parts don't meet.
    """
    from .clean import crossing_audit

    s = polyline_segments(paths)
    hit = crossing_audit(s.select(SCENE, F.col("id").alias("a"), F.col("k").alias("b"), "x0", "y0", "x1", "y1"), nodes, edges)
    hit = hit.select(SCENE, F.col("a").alias("id"), F.col("b").alias("k"), "component", "u", "v", "x", "y", "position").join(s.select(SCENE, "id", "k", "before"), [SCENE, "id", "k"])
    first = F.min(F.struct((F.col("before") + F.col("position")).alias("position"), "u", "v")).alias("m")
    return hit.groupBy(SCENE, "id", "component", "x", "y").agg(first).select(SCENE, "id", "component", "m.u", "m.v", "x", "y", "m.position")


def polyline_probability(paths: DataFrame, cells: DataFrame) -> DataFrame:
    """(scene, id, mean, p10) of bilinear samples at most 1 apart, 16 at least, along polylines; a missing cell counts as 0, a scene without cells gives 0.5."""
    from .raster import bilinear

    n = F.greatest(F.lit(16), F.ceil(F.round(geom.arc_length(F.col("polyline")), 9)).cast("int") + 1)
    at = paths.join(cells.select(SCENE).distinct(), SCENE, "left_semi").select(SCENE, "id", F.posexplode(geom.resample(F.col("polyline"), n)).alias("k", "p"))
    at = at.select(SCENE, F.struct("id", "k").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    v = at.select(SCENE, "id").join(bilinear(at, cells), [SCENE, "id"], "left").select(SCENE, F.col("id.id").alias("id"), F.round(F.coalesce("value", F.lit(0.0)), 9).alias("p"))
    out = v.groupBy(SCENE, "id").agg(F.avg("p").alias("mean"), F.percentile("p", F.lit(0.1)).alias("p10"))
    return paths.select(SCENE, "id").join(out, PAIR, "left").fillna({"mean": 0.5, "p10": 0.5})


def split_corridors(paths: DataFrame, nodes: DataFrame, edges: DataFrame, cells: DataFrame, max_length: float = 250.0, max_detour: float = 2.5, least_mean: float = 0.15, least_p10: float = 0.02) -> DataFrame:
    """Gate corridors (scene, id, a, b, polyline) between components a and b, and give the parts of those that meet a third component.

    Rows: scene, id, part (0 for the corridor itself), a, b, start, stop, polyline, length, detour, mean, p10, stops, rejection_flags, status. A corridor with
    third components has the flag third_component_requires_split and its stops in order of arc length; each way between two stops that follow each other, of different components and at
    least 2 long, is a part with the same gates. Parts meet what their corridor meets between their ends.
    """
    paths = stored(paths.where(F.size("polyline") > 1).select(SCENE, "id", "a", "b", F.transform("polyline", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("polyline")), "corridors")
    hits = polyline_crossings(paths, nodes, edges)
    met = hits.groupBy(SCENE, "id").agg(F.array_sort(F.collect_list(F.struct(F.round("position", 9).alias("s"), F.col("component").alias("c"), "u", "v", "x", "y"))).alias("hits"))
    rows = paths.join(met, PAIR, "left").withColumn("hits", F.coalesce("hits", F.array().cast(met.schema["hits"].dataType)))
    rows = rows.withColumn("length", geom.arc_length(F.col("polyline"))).withColumn("stops", F.filter("hits", lambda h: (h["c"] != F.col("a")) & (h["c"] != F.col("b"))))
    stop = lambda s, c: F.struct(s.alias("s"), c.alias("c"))
    line = F.concat(F.array(stop(F.lit(0.0), F.col("a"))), F.transform("stops", lambda h: stop(h["s"], h["c"])), F.array(stop(F.col("length"), F.col("b"))))
    # of stops of one component in a row the first stays
    line = F.filter(line, lambda h, i: (i == 0) | (h["c"] != F.get(line, i - 1)["c"]))
    rows = stored(rows.withColumn("line", line), "stops")
    whole = rows.select(SCENE, "id", F.lit(0).alias("part"), "a", "b", F.lit(0.0).alias("start"), F.col("length").alias("stop"), "polyline", "hits", "stops")
    pair = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(i.alias("part"), F.get("line", i - 1).alias("p"), F.get("line", i).alias("q")))
    parts = rows.where(F.size("stops") > 0).withColumn("e", F.explode(pair)).where("e.q.s - e.p.s >= 2")
    inside = F.filter("hits", lambda h: (h["s"] >= F.col("start")) & (h["s"] <= F.col("stop")))
    parts = parts.select(SCENE, "id", "e.part", F.col("e.p.c").alias("a"), F.col("e.q.c").alias("b"), F.col("e.p.s").alias("start"), F.col("e.q.s").alias("stop"), geom.sliced(F.col("polyline"), F.col("e.p.s"), F.col("e.q.s")).alias("polyline"), "hits")
    parts = parts.withColumn("hits", inside).withColumn("stops", F.filter("hits", lambda h: (h["c"] != F.col("a")) & (h["c"] != F.col("b"))))
    every = stored(whole.unionByName(parts), "parts")
    p = polyline_probability(every.select(SCENE, F.struct("id", "part").alias("id"), "polyline"), cells).select(SCENE, "id.id", "id.part", "mean", "p10")
    first, last = F.get("polyline", F.lit(0)), F.element_at("polyline", -1)
    every = every.join(p, [SCENE, "id", "part"]).withColumn("length", geom.arc_length(F.col("polyline")))
    every = every.withColumn("detour", F.col("length") / F.greatest(geom.distance(first["x"], first["y"], last["x"], last["y"]), F.lit(1e-6)))
    rules: list[tuple[Column, str]] = [
        (F.round("length", 6) > max_length, "max_corridor_length"), (F.round("detour", 6) > max_detour, "max_detour_ratio"), (F.round("mean", 9) < least_mean, "min_mean_probability"), (F.round("p10", 9) < least_p10, "min_p10_probability"), (F.size("stops") > 0, "third_component_requires_split"),
    ]
    flags = F.array_compact(F.array(*(F.when(c, n) for c, n in rules)))
    every = every.withColumn("rejection_flags", flags).withColumn("status", F.when(F.size("rejection_flags") == 0, "proposed").otherwise("rejected_by_hard_gate"))
    return every.select(SCENE, "id", "part", "a", "b", "start", "stop", "polyline", "length", "detour", "mean", "p10", F.transform("stops", lambda h: F.struct(h["s"].alias("position"), h["c"].alias("component"), h["x"].alias("x"), h["y"].alias("y"))).alias("stops"), "rejection_flags", "status")
