"""N-gram Jaccard join over signature trees.

1. Evidence. A set that links with another has nearly all its elements in common with it. A sample of the elements of all
   sets, chosen by hash, is looked up among those of the other sets, and sets with too few elements in common with any are
   done. The others, few as a rule, are stored once and looked up again with all their elements.
2. Roots. The hash space is cut into one part more than the most differences that two linked sets can have, so linked sets
   agree wholly on at least one part (pigeonhole). Sets that agree on a part hang under one root. Only chains of
   neighbours are emitted, never the pairs of a group, and the roots are the connected components of the chains.
3. Trees. The sets of a root are the leaves of a tree. A node holds the OR of its sets' bitmaps, the range of their
   sizes and the most bits that one of them lost to collisions. Two nodes are traversed together, from the top, and dropped
   where their sizes or the most overlap that the bitmaps allow are too small for any pair below them; pairs of sets that
   stay are counted exactly. A root of at most NODE sets is traversed in one task. A larger one is first cut into such
   trees by its sets' least hashes, which links most of what links; then sets without evidence outside their own component
   are dropped, and a tree over the rest is traversed level by level as a table of node pairs.
4. Components of the links, with exact copies attached to their set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from . import evidence
from .common import free, lookup, stored, text_key, tidy
from .evidence import rows_of
from .pieces import slices
from .shingles import U, mixed, shingle_sets

#: Sets below one node of the trees that are traversed as tables.
NODE = 256
#: Sets below a leaf, and children of a node, of the trees inside a task.
LEAF, FAN = 16, 4
#: Growth of the set size from one band to the next.
BAND = 1.5
#: Elements that a set is looked up with at least.
LEAST = 64
#: Bits of the bitmaps of nodes that are joined as tables.
NODE_BITS = 1 << 13


class Linking:
    """Two sets link when |A & B| >= share * |A | B|; share is num / den exactly."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def differences(self, size: int) -> int:
        """The most elements in which linked sets of at most this size differ: (1 - t) / (1 + t) of both sizes."""
        return (self.den - self.num) * 2 * size // (self.den + self.num)

    def missing(self, n):
        """The most elements of a set of n that a linked set lacks."""
        return n - (-(-self.num * n // self.den))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def least(self, a, b):
        """The smallest overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.den + self.num))

    def largest_partner(self, n):
        return n * self.den // self.num

    def sampled(self, n: np.ndarray) -> np.ndarray:
        """Share of the hash space whose elements stand for a set of n; never more for a larger set. More than `missing` of them on average."""
        return np.minimum(1.0, np.maximum(5 / 3 * (1 - self.num / self.den), LEAST / np.maximum(n, 1)))


def bands(size: int, rule: Linking) -> Iterator[tuple[int, int]]:
    """(number, top size) of the bands in which a set meets its partners: its own, and that of every larger partner."""
    k = 0
    most = rule.largest_partner(size)
    top = 1
    while top < size:
        k, top = k + 1, grown(top)
    yield k, top
    while top < most:
        k, top = k + 1, grown(top)
        yield k, top


def grown(top: int) -> int:
    return max(top + 1, math.floor(top * BAND))


def part_keys(hashes: np.ndarray, rule: Linking) -> np.ndarray:
    """Keys of a set, such that linked sets have one in common.

    For each band the hash space is cut into slightly more parts than the most differences D of two sets of the band, plus one; a
    key is the content of a part. If more than D parts are filled, one filled part is equal in both sets. A set
    that fills fewer adds the keys of its empty parts, and so does its partner, unless the partner fills enough.
    """
    out = []
    for number, top in bands(len(hashes), rule):
        need = rule.differences(top) + 1
        parts = need if need == 1 else need + need // 50 + 3
        # the parts are equal shares of the top 32 bits
        at = ((hashes >> U(32)) * U(parts)) >> U(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        content = np.add.reduceat(mixed(hashes + U(1)), first)
        salt = mixed(np.array([number * 2_000_003], U) + U(7))[0]
        out.append(mixed(content ^ mixed(at[first] + salt)))
        if len(first) < need:
            empty = np.setdiff1d(np.arange(parts, dtype=U), at[first])
            out.append(mixed(mixed(empty + salt) + U(11)))
    return np.concatenate(out)


def set_digest(s: np.ndarray) -> bytes:
    """128 bits of a set: two sums of mixed hashes."""
    return np.array([mixed(s + U(3)).sum(dtype=U), mixed(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)], "<u8").tobytes()


# ---- 1. evidence

SETS = {"doc_id": pa.int64(), "t1": pa.int64(), "t2": pa.int64(), "n": pa.int64(), "looked": pa.int64(), "digest": pa.binary(), "id": pa.int64()}
SETS_SCHEMA = "doc_id long, t1 long, t2 long, n long, looked long, digest binary, id long, "


def sampled(hashes: np.ndarray, n: int, rule: Linking) -> np.ndarray:
    """Which of the hashes every set of n sends."""
    return (mixed(hashes + U(13)) >> U(32)).astype(np.float64) < rule.sampled(n) * 2.0**32


def sets_with_evidence(docs: DataFrame, width: int, rule: Linking, buckets: int) -> DataFrame:
    """Rows of SETS, one per document, and blobs that count how many elements of a set (id) also stand in others.

    looked counts the elements of a set that all its possible partners would send as well; at least that many less
    `missing` are met if it links. The id is the first half of the set's digest.
    """
    fields = SETS | evidence.FIELDS

    def run(batches):
        keys, ids, held, seen, dealt = [], [], 0, set(), 0
        for b in batches:
            doc_ids, t1, t2, texts = (c.to_pylist() for c in b.columns)
            for lo, hi in slices([len(t) for t in texts]):
                sets = shingle_sets([t.lower() for t in texts[lo:hi]], width)
                n = [len(s) for s in sets]
                digests = [set_digest(s) if len(s) else None for s in sets]
                own = [None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests]
                looked = [int(sampled(s, rule.largest_partner(len(s)), rule).sum()) if len(s) else 0 for s in sets]
                for s, d, i in zip(sets, digests, own):
                    if d is not None and d not in seen:
                        seen.add(d)
                        keys.append(s[sampled(s, len(s), rule)])
                        ids.append(np.full(len(keys[-1]), i, np.int64))
                        held += len(keys[-1])
                yield rows_of(fields, bucket=[(dealt + i) % buckets for i in range(hi - lo)], doc_id=doc_ids[lo:hi], t1=t1[lo:hi], t2=t2[lo:hi], n=n, looked=looked, digest=digests, id=own)
                dealt += hi - lo
                if held > evidence.HELD:
                    yield from evidence.sent(np.concatenate(keys), np.concatenate(ids), None, buckets, fields)
                    keys, ids, held, seen = [], [], 0, set()
        if keys:
            yield from evidence.sent(np.concatenate(keys), np.concatenate(ids), None, buckets, fields)

    raw = docs.select("doc_id", "t.t1", "t.t2", "text").mapInArrow(tidy(run), SETS_SCHEMA + evidence.SCHEMA)
    return evidence.met(raw, buckets, SETS, SETS_SCHEMA)


def elements_elsewhere(sets: DataFrame, width: int, buckets: int) -> DataFrame:
    """(row, met) of (row, tag, space, text): how many elements of a set stand in sets of the same space with another tag. Sets with none are left out."""

    def run(batches):
        keys, ids, tags, held = [], [], [], 0
        for b in batches:
            rows, own, spaces, texts = (c.to_pylist() for c in b.columns)
            for lo, hi in slices([len(t) for t in texts]):
                for row, tag, space, s in zip(rows[lo:hi], own[lo:hi], spaces[lo:hi], shingle_sets([t.lower() for t in texts[lo:hi]], width)):
                    keys.append(s ^ mixed(np.array([space], np.int64).view(U)))
                    ids.append(np.full(len(s), row, np.int64))
                    tags.append(np.full(len(s), tag, np.int64))
                    held += len(s)
                if held > evidence.HELD:
                    yield from evidence.sent(*map(np.concatenate, (keys, ids, tags)), buckets, evidence.FIELDS)
                    keys, ids, tags, held = [], [], [], 0
        if keys:
            yield from evidence.sent(*map(np.concatenate, (keys, ids, tags)), buckets, evidence.FIELDS)

    found = evidence.met(sets.select("row", "tag", "space", "text").mapInArrow(tidy(run), evidence.SCHEMA), buckets)
    return evidence.summed(found, buckets).withColumnRenamed("id", "row")


def enough(met: str, of: str, rule: Linking) -> Column:
    """Whether so many of `of` looked up elements of a set of n are met that it may link."""
    return F.coalesce(F.col(met), F.lit(0)) >= F.expr(f"{of} - (n - ((n * {rule.num} + {rule.den - 1}) div {rule.den}))")


# ---- 2. roots


def chained_keys(sets: DataFrame, width: int, rule: Linking) -> DataFrame:
    """(row, least, other, key, prev) of (row, text): one row per set with its two least hashes, and rows (row, key, prev).

    A key that a task has met before is not sent again: the row is chained to the one it was met in (prev). So a
    key leaves a task once, however many of its sets hold it.
    """
    fields = {c: pa.int64() for c in ("row", "least", "other", "key", "prev")}

    def run(batches):
        keys, rows, held = [], [], 0

        def flush():
            k, r = np.concatenate(keys), np.concatenate(rows)
            order = np.argsort(k, kind="stable")
            k, r = k[order], r[order]
            same = np.concatenate([[False], k[1:] == k[:-1]])
            yield rows_of(fields, key=k[~same].view(np.int64), row=r[~same])
            if same.any():
                chain = np.unique(np.stack([r[same], np.concatenate([[0], r[:-1]])[same]], 1), axis=0)
                yield rows_of(fields, row=chain[:, 0], prev=chain[:, 1])

        for b in batches:
            ids, texts = (c.to_pylist() for c in b.columns)
            for lo, hi in slices([len(t) for t in texts]):
                sets = shingle_sets([t.lower() for t in texts[lo:hi]], width)
                for row, s in zip(ids[lo:hi], sets):
                    keys.append(part_keys(s, rule))
                    rows.append(np.full(len(keys[-1]), row, np.int64))
                    held += len(keys[-1])
                yield rows_of(fields, row=ids[lo:hi], least=[int(s[0].view(np.int64)) for s in sets], other=[int(mixed(s + U(9)).min().view(np.int64)) for s in sets])
                if held > evidence.HELD:
                    yield from flush()
                    keys, rows, held = [], [], 0
        if keys:
            yield from flush()

    return sets.select("row", "text").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in fields))


# ---- 3. trees


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    at = (s >> U(7)) % U(bits)
    out = np.zeros(bits // 64, U)
    np.bitwise_or.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


@dataclass
class Node:
    """What bounds the overlap of the sets below: the OR of their bitmaps, their sizes, the most bits that one lost. start and end: their places, from the smallest set."""

    any: np.ndarray
    sizes: tuple[int, int]
    lost: int
    start: int = 0
    end: int = 0
    children: list[Node] = field(default_factory=list)

    def apart(self, other: Node, rule: Linking) -> bool:
        """Whether no set below links with one below the other: two common elements on one bit are lost in both sets."""
        if rule.den * min(self.sizes[1], other.sizes[1]) < rule.num * max(self.sizes[0], other.sizes[0]):
            return True
        most = int(np.bitwise_count(self.any & other.any).sum()) + min(self.lost, other.lost)
        return most < rule.least(self.sizes[0], other.sizes[0])


class Tree:
    """A signature tree over sets in the order of their sizes."""

    def __init__(self, rows: list[int], sets: list[np.ndarray], bits: int):
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.rows, self.sets = [rows[i] for i in order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.maps = np.stack([bitmap(s, bits) for s in self.sets])
        self.lost = self.n - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        self.top = self.node(0, len(sets))

    def node(self, start: int, end: int) -> Node:
        step = -(-(end - start) // FAN)
        below = [self.node(a, min(end, a + step)) for a in range(start, end, step)] if end - start > LEAF else []
        own = np.bitwise_or.reduce([b.any for b in below] if below else self.maps[start:end], 0)
        return Node(own, (int(self.n[start]), int(self.n[end - 1])), int(self.lost[start:end].max()), start, end, below)


def bits_for(largest: int) -> int:
    """Bits of a bitmap for sets of that size: at least four times as many up to a bound."""
    return 1 << min(14, max(6, (4 * largest - 1).bit_length()))


def traversed(x: Node, y: Node, rule: Linking) -> Iterator[tuple[Node, Node]]:
    """The pairs of leaves, one below each node, that the bounds don't tell apart."""
    if x.apart(y, rule):
        return
    if x is y and x.children:
        for i, c in enumerate(x.children):
            for d in x.children[i:]:
                yield from traversed(c, d, rule)
    elif x.children and (not y.children or x.end - x.start >= y.end - y.start):
        for c in x.children:
            yield from traversed(c, y, rule)
    elif y.children:
        for d in y.children:
            yield from traversed(x, d, rule)
    else:
        yield x, y


def links(left: Tree, right: Tree, rule: Linking, known: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Links between the sets of two trees, or of one where left is right, that connect all that they link.

    known: the component in which a row is already; pairs of one component are passed over.
    """
    group = {c: c for c in known.values()}

    def root(row: int) -> int:
        x = known[row]
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for x, y in traversed(left.top, right.top, rule):
        if len({root(r) for r in left.rows[x.start : x.end]} | {root(r) for r in right.rows[y.start : y.end]}) == 1:
            continue
        most = np.bitwise_count(left.maps[x.start : x.end, None] & right.maps[None, y.start : y.end]).sum(2, dtype=np.int64)
        most += np.minimum(left.lost[x.start : x.end, None], right.lost[None, y.start : y.end])
        for i, j in np.argwhere(most >= rule.least(left.n[x.start : x.end, None], right.n[None, y.start : y.end])).tolist():
            row, other = left.rows[x.start + i], right.rows[y.start + j]
            if root(row) != root(other):
                s, t = left.sets[x.start + i], right.sets[y.start + j]
                common = len(np.intersect1d(s, t, assume_unique=True))
                if rule.linked(common, len(s), len(t)):
                    group[root(row)] = root(other)
                    yield row, other


def tree_links(units: DataFrame, width: int, rule: Linking) -> DataFrame:
    """(a, b) links of (unit, side, row, comp, text), sorted by unit and side within partitions. A unit has one tree (side 0), or two whose sets are compared.

    The second tree of a unit comes in pieces of at most NODE sets.
    """

    def run(batches):
        now, held, known, first = None, ([], []), {}, None
        found: list[tuple[int, int]] = []

        def tree(side: int, bits: int) -> Tree:
            rows, texts = zip(*held[side])
            return Tree(list(rows), shingle_sets([t.lower() for t in texts], width), bits)

        def compare(last: bool):
            if held[0] and (held[1] or (last and first is None and len(held[0]) > 1)):
                bits = bits_for(max(len(t) for side in held for _, t in side) // 4)
                left = tree(0, bits)
                found.extend(links(left, tree(1, bits) if held[1] else left, rule, known))

        for b in batches:
            for unit, side, row, comp, text in zip(*(c.to_pylist() for c in b.columns)):
                if unit != now:
                    compare(True)
                    now, held, known, first = unit, ([], []), {}, None
                elif len(held[1]) >= NODE:
                    compare(False)
                    held, first = (held[0], []), True
                known[row] = comp
                held[side].append((row, text))
            if found:
                yield rows_of({"a": pa.int64(), "b": pa.int64()}, **dict(zip("ab", zip(*found))))
                found = []
        compare(True)
        if found:
            yield rows_of({"a": pa.int64(), "b": pa.int64()}, **dict(zip("ab", zip(*found))))

    rows = units.select("unit", "side", "row", "comp", "text").repartition("unit").sortWithinPartitions("unit", "side")
    return rows.mapInArrow(tidy(run), "a long, b long")


def nodes_linked(sets: DataFrame, members: DataFrame, width: int, rule: Linking) -> DataFrame:
    """Links within the roots' trees: the whole tree where NODE holds it, else subtrees dealt by two least hashes in turn.

    members: (row, tree, nodes, least, other).
    """
    whole = F.array(F.struct(F.lit(0).alias("t"), F.lit(0).cast("long").alias("m")))
    halves = F.array(*(F.struct(F.lit(i).alias("t"), F.pmod(F.col(c), F.col("nodes") * 4).alias("m")) for i, c in enumerate(("least", "other"))))
    dealt = members.select("row", "tree", F.explode(F.when(F.col("nodes") > 1, halves).otherwise(whole)).alias("d")).select("row", F.concat_ws("/", "tree", "d.t", "d.m").alias("node"))
    full = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / NODE).alias("cuts"))
    units = lookup(dealt, full.where("size > 1"), "node", "size", dealt.count())
    units = units.select("row", F.col("row").alias("comp"), F.lit(0).alias("side"), F.concat_ws("/", "node", F.pmod(F.xxhash64("row"), F.col("cuts"))).alias("unit"))
    return tree_links(units.join(sets.select("row", "text"), "row"), width, rule)


PLACE = ["tree", "rest", "band", "cut"]
NODES = {"lo": pa.int64(), "hi": pa.int64(), "lost": pa.int64(), "c_lo": pa.int64(), "c_hi": pa.int64(), "bits": pa.binary()}


def node_rows(sets: DataFrame, width: int) -> DataFrame:
    """PLACE and NODES of (PLACE, comp, text): each set as a node of its own."""

    def run(batches):
        for b in batches:
            comps, texts = b.column(4).to_pylist(), b.column(5).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                own = shingle_sets([t.lower() for t in texts[lo:hi]], width)
                maps = [bitmap(s, NODE_BITS) for s in own]
                n = [len(s) for s in own]
                lost = [k - int(np.bitwise_count(m).sum()) for k, m in zip(n, maps)]
                columns = [n, n, lost, comps[lo:hi], comps[lo:hi], [m.tobytes() for m in maps]]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:4]), *(pa.array(c, k) for c, k in zip(columns, NODES.values()))], [*PLACE, *NODES])

    return sets.select(*PLACE, "comp", F.col("text")).mapInArrow(tidy(run), "tree long, rest int, band int, cut long, lo long, hi long, lost long, c_lo long, c_hi long, bits binary")


def or_combined(nodes: DataFrame) -> DataFrame:
    """One node for each place: the OR of the bitmaps, and the ranges of sizes and components."""

    def run(batches):
        now, sums = None, None

        def out():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(now, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))), *(pa.array([v], k) for v, k in zip([*sums[:5], sums[5].tobytes()], NODES.values()))], [*PLACE, *NODES])

        for b in batches:
            for *place, lo, hi, lost, c_lo, c_hi, bits in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(bits, U)
                if place != now:
                    if now is not None:
                        yield from out()
                    now, sums = place, [lo, hi, lost, c_lo, c_hi, own.copy()]
                else:
                    sums[:5] = min(sums[0], lo), max(sums[1], hi), max(sums[2], lost), min(sums[3], c_lo), max(sums[4], c_hi)
                    sums[5] |= own
        if now is not None:
            yield from out()

    return nodes.select(*PLACE, *NODES).repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(tidy(run), nodes.select(*PLACE, *NODES).schema)


def node_pairs(pairs: DataFrame, rule: Linking) -> DataFrame:
    """The pairs (a, b: structs of PLACE and NODES) that the bounds don't tell apart, without bitmaps."""
    place = [f"{s}_{c}" for s in "ab" for c in PLACE]
    flat = pairs.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in [*PLACE, *NODES]))
    # components that are one and the same, and sizes too far apart, need no bitmap
    one = (F.col("a_c_lo") == F.col("b_c_hi")) & (F.col("a_c_hi") == F.col("b_c_lo"))
    flat = flat.where(~one & (rule.den * F.least("a_hi", "b_hi") >= rule.num * F.greatest("a_lo", "b_lo")))

    def run(batches):
        for b in batches:
            ends = [[Node(np.frombuffer(bits, U), (lo, hi), lost) for lo, hi, lost, bits in zip(*(b[f"{s}_{c}"].to_pylist() for c in ("lo", "hi", "lost", "bits")))] for s in "ab"]
            near = pa.array([not x.apart(y, rule) for x, y in zip(*ends)], pa.bool_())
            yield b.select(place).filter(near)

    return flat.mapInArrow(tidy(run), flat.select(*place).schema)


def tall_links(sets: DataFrame, tall: DataFrame, width: int, rule: Linking, buckets: int) -> DataFrame | None:
    """Links between components of the roots above NODE sets; tall: (row, tree, comp). None: nothing is left to compare."""
    held = tall.join(sets, "row")
    met = elements_elsewhere(held.select("row", F.col("comp").alias("tag"), F.col("tree").alias("space"), "text"), width, buckets)
    left = stored(tall.join(sets.select("row", "n"), "row").join(met, "row").where(enough("met", "n", rule)).select("row", "tree", "comp", "n"), "left")
    by = left.groupBy("tree", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("tree").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("size"), F.count(F.lit(1)).alias("comps"))
    by = by.where("comps > 1").select("tree", F.col("top.comp").alias("top"), "size")
    if by.isEmpty():
        return None
    placed = lookup(left, by, "tree", "size", left.count()).select("row", "tree", "comp", (F.col("comp") != F.col("top")).cast("int").alias("rest"), F.floor(F.log("n") / math.log(1.1)).cast("int").alias("band"))
    counts = placed.groupBy("tree", "rest", "band").agg(F.count(F.lit(1)).alias("k")).withColumn("cuts", F.ceil(F.col("k") / NODE))
    # bands of a tree are few, so this join has no hot key but by way of a band, which is cut here
    placed = stored(placed.join(counts, ["tree", "rest", "band"]).withColumn("cut", F.pmod(F.xxhash64("row"), F.col("cuts"))).select("row", "comp", *PLACE), "placed")
    height = math.ceil(math.log(max(counts.agg(F.max("cuts")).first()[0], 1), 16) - 1e-9)
    levels = [stored(or_combined(node_rows(placed.join(sets.select("row", "text"), "row").select(*PLACE, "comp", "text"), width)), "nodes")]
    for _ in range(height):
        levels.append(stored(or_combined(levels[-1].withColumn("cut", F.shiftright("cut", 4))), "nodes"))

    def side(nodes: DataFrame, name: str) -> DataFrame:
        return nodes.select(*(F.col(c).alias(f"{name}_{c}") for c in PLACE), F.struct(*PLACE, *NODES).alias(name))

    # both in the rest: each pair once
    once = (F.col("b_rest") == 0) | (F.struct("a_band", "a_cut") <= F.struct("b_band", "b_cut"))
    tops = side(levels[-1], "b").withColumnRenamed("b_tree", "a_tree")
    pairs = stored(node_pairs(side(levels[-1].where("rest = 1"), "a").join(tops, "a_tree").where(once), rule), "pairs")
    for nodes in levels[-2::-1]:
        below = pairs
        for s in "ab":
            below = below.withColumn(f"{s}_cut", F.explode(F.sequence(F.col(f"{s}_cut") * 16, F.col(f"{s}_cut") * 16 + 15)))
            below = below.join(side(nodes, s), [f"{s}_{c}" for c in PLACE])
        pairs = stored(node_pairs(below.where(once), rule), "pairs")
    # a node of the rest meets its partners, some at a time
    a = [F.col(f"a_{c}") for c in PLACE]
    many = pairs.groupBy(*(f"a_{c}" for c in PLACE)).agg(F.ceil(F.count(F.lit(1)) / 16).alias("chunks"))
    pairs = pairs.join(many, [f"a_{c}" for c in PLACE]).withColumn("unit", F.concat_ws("/", *a, F.pmod(F.xxhash64("b_rest", "b_band", "b_cut"), F.col("chunks"))))
    lefts = pairs.select("unit", F.lit(0).alias("side"), *(F.col(f"a_{c}").alias(c) for c in PLACE)).distinct()
    rights = pairs.select("unit", F.lit(1).alias("side"), *(F.col(f"b_{c}").alias(c) for c in PLACE))
    units = lefts.unionByName(rights).join(placed, PLACE).join(sets.select("row", "text"), "row")
    found = stored(tree_links(units, width, rule), "links")
    free(*levels)
    return found


# ---- the join


def linked_sets(docs: DataFrame, width: int, share: float | str) -> tuple[DataFrame, DataFrame]:
    """The documents as rows (doc_id, t1, t2, n, digest), and (digest, class) of the distinct sets that link with others.

    docs: (doc_id, text). The class is the digest of one of the sets that are reachable by links.
    """
    rule = Linking(*Fraction(str(share)).as_integer_ratio())
    raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = raw.select("doc_id", text_key(F.col("text")).alias("t"), F.col("text").cast("binary").alias("text"))
    n_bytes = raw.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word has about six bytes
    buckets = evidence.buckets_for(n_bytes / 6 * float(rule.sampled(np.int64(1 << 40))))
    found = stored(sets_with_evidence(raw, width, rule, buckets), "sets")
    rows = found.where("n is not null").select("doc_id", "t1", "t2", "n", "digest")
    met = evidence.summed(found.where("met is not null"), buckets)
    # one document's text stands for a set; with its id in the key the copies of a text don't meet
    at = F.coalesce("doc_id", F.lit(-(2**63))).alias("at")
    groups = found.where("n > 0").groupBy("digest").agg(F.min(F.struct(at, "t1", "t2")).alias("t"), F.first("id").alias("id"), F.first("n").alias("n"), F.first("looked").alias("looked"))
    near = groups.join(met, "id", "left").where(enough("met", "looked", rule)).select("digest", "n", "t.at", "t.t1", "t.t2")
    texts = raw.select(at, "t.t1", "t.t2", "text").join(near, ["at", "t1", "t2"]).dropDuplicates(["at", "t1", "t2"])
    sets = stored(texts.select(F.monotonically_increasing_id().alias("row"), "digest", "n", "text"), "texts")
    buckets = evidence.buckets_for(sets.agg(F.sum("n")).first()[0] or 0)
    met = elements_elsewhere(sets.select("row", F.col("row").alias("tag"), F.lit(0).cast("long").alias("space"), "text"), width, buckets)
    near = stored(sets.select("row", "n").join(met, "row").where(enough("met", "n", rule)).select("row"), "near")
    keys = stored(chained_keys(sets.join(near, "row"), width, rule), "keys")
    chain = keys.where("key is not null").select("row", F.lag("row").over(Window.partitionBy("key").orderBy("row")).alias("prev")).where("prev is not null")
    roots = stored(connected_components(chain.unionByName(keys.where("prev is not null").select("row", "prev")), "row", "prev"), "roots")
    hashes = keys.where("least is not null").select("row", "least", "other")
    sizes = roots.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumn("nodes", F.ceil(F.col("size") / NODE).cast("int"))
    members = lookup(roots, sizes, "component", "size", roots.count()).select(F.col("node").alias("row"), F.col("component").alias("tree"), "nodes")
    members = stored(members.join(hashes, "row"), "members")
    free(keys, roots)
    links = stored(nodes_linked(sets, members, width, rule), "links")
    tall = members.where("nodes > 1").select("row", "tree")
    if not tall.isEmpty():
        part = connected_components(links, "a", "b").withColumnsRenamed({"node": "row", "component": "comp"})
        more = tall_links(sets, stored(tall.join(part, "row", "left").select("row", "tree", F.coalesce("comp", "row").alias("comp")), "tall"), width, rule, buckets)
        links = links if more is None else links.unionByName(more)
    joined = connected_components(links, "a", "b")
    named = sets.select("row", "digest")
    classes = joined.select(F.col("node").alias("row"), "component").join(named, "row").join(named.select(F.col("row").alias("component"), F.col("digest").alias("class")), "component")
    return rows, stored(classes.select("digest", "class"), "classes")


def classed(docs: DataFrame, width: int, share: float | str) -> DataFrame:
    """(doc_id, t1, t2, n, class) of each document; documents without words have no class."""
    rows, classes = linked_sets(docs, width, share)
    worded = rows.where("digest is not null")
    sizes = worded.groupBy("digest").agg(F.count(F.lit(1)).alias("size")).join(classes, "digest", "left").withColumn("class", F.coalesce("class", "digest"))
    known = lookup(worded, sizes, "digest", "size", rows.count()).select("doc_id", "t1", "t2", "n", "class")
    return stored(known.unionByName(rows.where("digest is null").select("doc_id", "t1", "t2", "n", F.lit(None).cast("binary").alias("class"))), "classed")


def components(docs: DataFrame, width: int = 5, share: float | str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    A document's set are its distinct shingles of `width` words after lower-casing A-Z, the whole sequence where it has fewer
    words. Two documents link when intersection >= share * union, decided exactly. component_id is the least doc_id
    reachable by links, itself included. A null or empty text, or one without words, has no shingles and links
    with nothing. A null doc_id is its own component's id only where no other doc_id is in it. Rows that repeat a doc_id are
    documents of their own. No rows give no rows.
    """
    near = classed(docs.select("doc_id", "text"), width, share)
    ids = near.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    known = lookup(near.where("class is not null"), ids, "class", "size", near.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(near.where("class is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, width: int = 5, share: float | str = "0.8") -> DataFrame:
    """The documents less all but one of each component: of those with the least doc_id (nulls last) one with the least text key.

    Of rows that repeat doc_id and text one stays, whichever. Documents without words all stay, repeated ones too.
    """
    near = classed(docs.select("doc_id", "text"), width, share)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    best = near.where("class is not null").groupBy("class").agg(F.min(key).alias("best")).select("best.*").drop("none")
    times = near.where("class is not null").groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("times"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "t1", "t2")]
    best = stored(best.alias("x").join(times.alias("y"), same).select("x.*", "times"), "best")
    empty = near.where("class is null").select("doc_id", "t1", "t2").distinct().withColumn("times", F.lit(1).cast("long"))
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.select(*docs.columns).toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    rows = rows.withColumn("t", text_key(F.coalesce(F.col(at["text"]), F.lit("")))).select("*", "t.t1", "t.t2", F.col(at["doc_id"]).alias("doc_id")).drop("t")
    kept = rows.alias("x").join(best.unionByName(empty).alias("y"), same).select(*(F.col(f"x.{c}") for c in [*names, "t1", "t2"]), "times")
    out = kept.where("times = 1").select(*names)
    if not best.where("times > 1").isEmpty():
        out = out.unionByName(kept.where("times > 1").dropDuplicates([at["doc_id"], "t1", "t2"]).select(*names))
    return out.toDF(*docs.columns)
