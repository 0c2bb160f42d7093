"""Cross-tokenizer alignment by products of token-byte incidence matrices in compressed sparse rows."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lookup, quoted, stored, tidy, with_row_id
from .pieces import slices

#: What stands for a space in the pieces of the second tokenizer, and how it writes a byte (fixed values).
MARK = "▁"
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
#: White space before which a unit may start: no piece holds it behind another character.
BREAKS = " \n\t"
#: A unit is white space, what follows up to one of BREAKS behind a character that isn't white space, or white space at the end.
UNIT = re.compile(rf"\s*\S+(?:[^\S{BREAKS}]\s*\S*)*|\s+")
#: Units that a worker keeps between batches; beyond it starts afresh.
CACHE_UNITS = 300_000
#: Units that are encoded as one text, and aligned at once.
RUN, LEARNED = 512, 32_768
#: Id pairs that a task counts before it hands them on.
CACHE_PAIRS = 2_000_000
#: Up to so many id pairs the counts are broadcast (16 bytes a pair); more are joined by shuffle.
BROADCAST_PAIRS = 8_000_000


class Matrix:
    """A sparse matrix in compressed rows: row i has the columns cols[ptr[i]:ptr[i + 1]]."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, width: int):
        self.ptr, self.cols, self.width = ptr, cols, width

    @classmethod
    def of_spans(cls, start: np.ndarray, end: np.ndarray, width: int) -> Matrix:
        """Rows with a run of columns each."""
        size = end - start
        ptr = np.concatenate([[0], np.cumsum(size)])
        return cls(ptr, np.arange(ptr[-1]) - np.repeat(ptr[:-1] - start, size), width)

    def transposed(self) -> Matrix:
        order = np.argsort(self.cols, kind="stable")
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        return Matrix(np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))]), rows[order], len(self.ptr) - 1)

    def times(self, other: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, sum) of the product, row by row: each entry (i, k) adds row k of the other matrix to row i of the result."""
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        size = np.diff(other.ptr)[self.cols]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - other.ptr[self.cols], size)
        cells = np.sort(np.repeat(rows, size) * other.width + other.cols[at], kind="stable")  # runs are sorted already
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else cells
        return cells[first] // other.width, cells[first] % other.width, np.diff(np.append(first, len(cells)))


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones their own, the others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Two tokenizers over one text: a byte-level BPE file (a) of the tokenizers library and a sentencepiece model (b)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a) as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("dropout"):
            raise ValueError(f"{path_a}: only a byte-level BPE without normaliser and prefix space is aligned by units")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = byte_level_bytes()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(map(byte.__getitem__, x)) if all(c in byte for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        coded = list(map(BYTE_PIECE.fullmatch, pieces))
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for p, m in zip(pieces, coded)]
        if any(set(p.strip(MARK)) & {MARK, *BREAKS} or (p.endswith(MARK) and p.strip(MARK)) for p in pieces):
            raise ValueError(f"{path_b}: a piece holds white space behind another character, so texts can't be cut into units")
        self.mark = self.b.piece_to_id(MARK)
        self.size_a, self.size_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        #: ids as text: of a before a comma and before the bar, then of b before a comma and before the semicolon
        self.names = np.array([f"{i}{sign}" for t, signs in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(t)) for sign in signs], object)

    def by_unit(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each unit. The second tokenizer puts a mark before what it is given: it stands for the unit's own space, or is dropped."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        spaced = [u[0] == " " for u in units]
        b = self.b.encode([u[1:] if s else u for u, s in zip(units, spaced)], num_threads=1)
        # an empty text has no pieces, not even the mark
        return a, [ids if s and len(u) > 1 else [self.mark] if s else ids[1:] for u, s, ids in zip(units, spaced, b)]

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sound units in a row. RUN of them are encoded as one text, as they would stand in a document; none where bytes differ."""
        runs = ["".join(units[i : i + RUN]) for i in range(0, len(units), RUN)]
        a = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        b = [ids if r[0] == " " else ids[1:] for r, ids in zip(runs, self.b.encode([r[1:] if r[0] == " " else r for r in runs], num_threads=1))]
        for k, r in enumerate(runs):
            raw = r.encode()
            if not b"".join(map(self.bytes_a.__getitem__, a[k])) == raw == b"".join(map(self.bytes_b.__getitem__, b[k])):
                return np.empty(0, np.int64), np.empty(0, np.int64)
        flat = [np.concatenate([np.array(x, np.int64) for x in t]) for t in (a, b)]
        return flat[0], flat[1]


def sound(unit: str) -> bool:
    """Whether units like it can be encoded in a row: white space of BREAKS before it, none behind it, and no mark in it."""
    return unit[0] in BREAKS and not unit[-1].isspace() and MARK not in unit


class Aligner:
    """What the units of texts have: ids, groups, links. Each distinct unit is aligned once while the cache holds it."""

    def __init__(self, path_a: str, path_b: str):
        self.both = Tokenizers(path_a, path_b)
        self.width = len(self.both.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, n_links, n_group_links of each unit; -1 where the bytes differ
        self.counts = np.empty((0, 5), np.int64)
        #: the links' id pairs a * width + b, unit by unit
        self.ptr, self.links = np.zeros(1, np.int64), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        both = self.both
        good = [u for u in new if sound(u)]
        for k in range(0, len(good), LEARNED):
            part = good[k : k + LEARNED]
            flat_a, flat_b = both.encode(part)
            if len(flat_a):
                self.align(part, flat_a, flat_b, np.ones(len(part), bool))
            else:
                self.one_by_one(part)
        self.one_by_one([u for u in new if not sound(u)])

    def one_by_one(self, units: list[str]) -> None:
        if not units:
            return
        both = self.both
        ids_a, ids_b = both.by_unit(units)
        same = [b"".join(map(both.bytes_a.__getitem__, a)) == u.encode() == b"".join(map(both.bytes_b.__getitem__, b)) for u, a, b in zip(units, ids_a, ids_b)]
        flat_a, flat_b = (np.fromiter((i for x, s in zip(t, same) if s for i in x), np.int64) for t in (ids_a, ids_b))
        self.align(units, flat_a, flat_b, np.array(same, bool))

    def align(self, units: list[str], flat_a: np.ndarray, flat_b: np.ndarray, same: np.ndarray) -> None:
        """Keep the alignment of units whose ids stand in a row; those with other bytes have none."""
        both = self.both
        sizes = np.array([len(u.encode()) if s else 0 for u, s in zip(units, same.tolist())])
        end_a, end_b, end = np.cumsum(both.size_a[flat_a]), np.cumsum(both.size_b[flat_b]), np.cumsum(sizes)
        n_bytes = int(end[-1])
        x, y, _ = Matrix.of_spans(end_a - both.size_a[flat_a], end_a, n_bytes).times(Matrix.of_spans(end_b - both.size_b[flat_b], end_b, n_bytes).transposed())  # tokens that share a byte
        shared = np.intersect1d(end_a, end_b, assume_unique=True)  # where groups end
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        gx, _, _ = Matrix.of_spans(group_a, group_a + 1, len(shared)).times(Matrix.of_spans(group_b, group_b + 1, len(shared)).transposed())  # tokens that share a group
        unit_a, unit_b, unit_g = (np.searchsorted(end, e) for e in (end_a, end_b, shared))
        n = len(units)
        n_links = np.bincount(unit_a[x], minlength=n)
        counts = np.stack([np.bincount(unit_a, minlength=n), np.bincount(unit_b, minlength=n), np.bincount(unit_g, minlength=n), n_links, np.bincount(unit_a[gx], minlength=n)], axis=1)
        counts[~same] = -1
        # the signs behind ids: a comma, or what ends a group's side
        last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (group_a, group_b))
        word = np.concatenate([2 * flat_a + last_a, 2 * len(both.bytes_a) + 2 * flat_b + last_b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        names = both.names[word[order]].tolist()
        at = np.concatenate([[0], np.cumsum(counts[:, 0].clip(0) + counts[:, 1].clip(0))]).tolist()
        start = len(self.groups)
        self.units.update(zip(units, range(start, start + n)))
        self.groups += ["".join(names[i:j])[:-1] for i, j in zip(at, at[1:])]
        self.counts = np.concatenate([self.counts, counts])
        self.ptr = np.concatenate([self.ptr, self.ptr[-1] + np.cumsum(n_links)])
        self.links = np.concatenate([self.links, flat_a[x] * self.width + flat_b[y]])

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """For each text its five counts, its groups as text, and (id pairs ascending, occurrences) of its links."""
        if len(self.units) > CACHE_UNITS:
            self.forget()
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        new: dict[str, None] = {}
        for units in cut:
            new.update(dict.fromkeys(u for u in set(units) if u not in self.units))
        if new:
            self.learn(list(new))
        at = [np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)) for units in cut]
        counts, groups, links = np.zeros((len(texts), 5), np.int64), [], []
        none = np.empty(0, np.int64)
        for k, units in enumerate(at):
            own = self.counts[units]
            if not len(own) or own[:, 0].min() < 0:
                groups.append("")
                links.append((none, none))
                continue
            counts[k] = own.sum(axis=0)
            groups.append(";".join(map(self.groups.__getitem__, units.tolist())))
            distinct, times = np.unique(units, return_counts=True)
            size = self.ptr[distinct + 1] - self.ptr[distinct]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) - np.repeat(ends - size - self.ptr[distinct], size)
            pair, which = np.unique(self.links[place], return_inverse=True)
            links.append((pair, np.bincount(which, np.repeat(times, size)).astype(np.int64)))
        return counts, groups, links


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on in few bytes: the smallest type that holds them, compressed."""
    small = np.min_scalar_type(int(values.max()) if len(values) else 0)
    return small.char.encode() + zlib.compress(values.astype(small).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob[1:]), blob[:1].decode()).astype(np.int64)


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str, keep: list[str], digest: bool = False) -> DataFrame:
    """The columns `keep` of docs (as c0, c1, ...), COUNTS, groups (text, or its sha256 with digest), pairs and times (packed)."""
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*map(quoted, keep), F.coalesce(quoted(text), F.lit(""))).toDF(*kept, "text")
    added = [*((c, T.LongType()) for c in COUNTS), ("groups", T.StringType()), ("pairs", T.BinaryType()), ("times", T.BinaryType())]
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(*x) for x in added)])

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a, b in slices(list(map(len, texts))):
                counts, groups, links = own.texts(texts[a:b])
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                made = [*(pa.array(counts[:, i]) for i in range(5)), pa.array(groups, pa.string())]
                made += [pa.array([packed(x) for x in column], pa.binary()) for column in ([np.diff(p, prepend=0) for p, _ in links], [t for _, t in links])]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), *made], [*kept, *(c for c, _ in added)])

    return rows.mapInArrow(tidy(run), schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n): the number of documents that hold an id pair linked."""

    def counted(batches):
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged(parts):
            found, which = np.unique(np.concatenate([pairs, *parts]), return_inverse=True)
            return found, np.bincount(which, np.concatenate([n, *(np.ones(len(p), np.int64) for p in parts)]), minlength=len(found)).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        parts, waiting = [], 0
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                parts.append(np.cumsum(unpacked(blob)))
                waiting += len(parts[-1])
                if waiting > CACHE_PAIRS:
                    pairs, n = merged(parts)
                    parts, waiting = [], 0
            if len(pairs) > CACHE_PAIRS:  # as many as a task keeps
                yield out()
                pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        pairs, n = merged(parts)
        yield out()

    return links.select("pairs").mapInArrow(tidy(counted), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def by_broadcast(table: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Add n_best and count_sum to rows; the counts are sent to all tasks."""
    rows = counts.toArrow()
    pair, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] // width != pair[:-1] // width])) if len(pair) else np.empty(0, int)
    best = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(pair)))) == n if len(pair) else np.empty(0, bool)
    shared = table.sparkSession.sparkContext.broadcast((pair, np.where(best, -n, n)))  # a sign marks the best
    kept = [c for c in table.columns if c not in ("pairs", "times")]

    def run(batches):
        pair, signed = shared.value
        for batch in batches:
            n_best, total = [], []
            for p, t in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                found, times = signed[np.searchsorted(pair, np.cumsum(unpacked(p)))], unpacked(t)
                n_best.append(int(times[found < 0].sum()))
                total.append(int((np.abs(found) * times).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

    schema = T.StructType([*(table.schema[c] for c in kept), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return table.select(*kept, "pairs", "times").mapInArrow(tidy(run), schema)


def by_shuffle(table: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """The same by joins: frequent pairs are broadcast by lookup(), the others meet their counts in a shuffle."""

    def exploded(batches):
        for batch in batches:
            parts = [(np.cumsum(unpacked(p)), unpacked(t)) for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if parts:
                who = np.repeat(batch.column(0).to_numpy(), [len(p) for p, _ in parts])
                yield pa.RecordBatch.from_arrays([pa.array(who), *(pa.array(np.concatenate(x)) for x in zip(*parts))], ["row", "pair", "times"])

    numbered = stored(with_row_id(table, "row"), "numbered")
    a = F.expr(f"pair div {width}")
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    scored = stored(counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "scored")
    rows = numbered.select("row", "pairs", "times").mapInArrow(exploded, "row long, pair long, times long")
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    sums = lookup(rows, scored, "pair", "n", total).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")
    )
    kept = [c for c in table.columns if c not in ("pairs", "times")]
    return numbered.join(sums, "row", "left").select(*kept, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")))


def _summed(table: DataFrame, path_b: str, most: int) -> DataFrame:
    """aligned() with the sums over its corpus-wide counts."""
    table = stored(table, "aligned")
    counts = stored(pair_counts(table), "pair_counts")
    return (by_broadcast if counts.count() <= most else by_shuffle)(table, counts, piece_count(path_b))


def piece_count(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


RESULT = [*COUNTS, "n_best", "count_sum", "groups"]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", most: int = BROADCAST_PAIRS) -> DataFrame:
    """Add n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum and groups to documents.

    a are the ids that the tokenizers library gives for a space and the text by the byte-level BPE file at path_a, b those of the
    sentencepiece model at path_b for the text; strings of special tokens are plain text. Byte offsets where tokens of both
    end cut them into groups: `a1,a2|b1;a3|b2,b3`. Links are pairs of tokens whose byte ranges overlap, group links those in one group.
    An id pair's count is the number of rows that hold it linked; count_sum adds it over the links, and n_best counts links whose count is
    their a id's highest. A null or empty text, or one whose tokens' bytes differ from it, has zeros and no groups.
    Every row gives one row, repeated rows too; other columns stay, and columns with a name of the result are replaced. No rows give no rows.
    Up to `most` id pairs, the counts are broadcast, beyond that they are joined; both give the same.
    """
    own = [c for c in docs.columns if c.lower() not in RESULT]
    out = _summed(aligned(docs, path_a, path_b, text, own), path_b, most)
    return out.select(*(f"c{i}" for i in range(len(own))), *RESULT).toDF(*own, *RESULT)


def id_pairs(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """(a, b, n): the linked id pairs of all documents and the number of documents that hold each."""
    width = piece_count(path_b)
    pairs = pair_counts(aligned(docs, path_a, path_b, text, [], True))
    return pairs.select(F.expr(f"int(pair div {width})").alias("a"), F.expr(f"int(pair % {width})").alias("b"), "n")


def digests(docs: DataFrame, path_a: str, path_b: str, most: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, the counts and sums of align(), and groups_sha256, without storing texts and groups."""
    out = _summed(aligned(docs, path_a, path_b, "text", ["doc_id"], True), path_b, most)
    return out.select(F.col("c0").alias("doc_id"), *(c for c in RESULT if c != "groups"), F.col("groups").alias("groups_sha256"))
