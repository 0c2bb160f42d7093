"""Substring dedup by level-wise doubling: windows repeated at one length alone are looked at with twice that length."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import free, lookup, stored, text_key
from .evidence import rows_of
from .pieces import slices
from .shingles import U, hashed, mixed, window_hashes

WINDOW = 35
#: log2 of the most bits of the filter that tells the next level which windows repeat: 32 MB. Beyond some 10 ** 8 repeated windows it passes more, and more windows are compared; results stay exact.
FILTER_BITS = 28
#: Words of 64 bits in a slice of the filter.
SLICE_WORDS = 1 << 16
#: Windows that a task compares among themselves before it sends them.
HELD = 2_000_000


def sliding(v: np.ndarray, reach: int, least=np.minimum) -> np.ndarray:
    """Least (or greatest) of each run of `reach` values, by doubling."""
    have = 1
    while have * 2 <= reach:
        v, have = least(v[:-have], v[have:]), have * 2
    rest = reach - have
    return least(v[: len(v) - rest], v[rest:]) if rest else v


class Words:
    """The word hashes of several documents in a row, with each word's document, its first word and its end."""

    def __init__(self, texts: list[bytes]):
        self.h, first = hashed(texts)
        n = np.diff(first)
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.start, self.end = np.repeat(first[:-1], n), np.repeat(first[1:], n)


class Levels:
    """Which windows are still candidates at each length: first, then twice as long, then `width` words."""

    def __init__(self, width: int):
        self.width = width
        self.second = max(1, -(-width // 2))
        self.first = max(1, -(-self.second // 2))

    def anchors(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places) of the first windows that are the least of all those in some window of the whole width.

        Equal windows of the whole width have them at the same places, so they stand for all others.
        """
        reach = self.width - self.first + 1
        v = window_hashes(w.h, self.first)
        if len(v) < reach:
            return v[:0], np.empty(0, np.int64)
        low = sliding(v, reach)
        low = np.where(np.arange(len(low)) + self.width <= w.end[: len(low)], low, U(0))  # not across documents
        zeros = np.zeros(reach - 1, U)
        high = sliding(np.concatenate([zeros, low, zeros]), reach, np.maximum)
        at = np.flatnonzero((high == v) & (high > 0))
        return v[at], at

    def doubled(self, w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, places) of the windows of the second length that start with, or end with, the windows at `at`.

        A window of the whole width holds one of the two.
        """
        v = window_hashes(w.h, self.second)
        right = at[at + self.second <= w.end[at]]
        left = at - (self.second - self.first)
        left = left[left >= w.start[at]]
        return np.concatenate([v[right], mixed(v[left] + U(1))]), np.concatenate([right, left])

    def whole(self, w: Words, at: np.ndarray) -> np.ndarray:
        """Places of the windows of the whole width around those of the second length."""
        low = np.maximum(at - (self.width - self.second), w.start[at])
        high = np.minimum(at, w.end[at] - self.width)
        some = high >= low
        mark = np.zeros(len(w.h) + 1, np.int64)
        np.add.at(mark, low[some], 1)
        np.add.at(mark, high[some] + 1, -1)
        return np.flatnonzero(np.cumsum(mark) > 0)


class Filter:
    """Keys in a bit array; it may say yes for others, never no for its own."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.words = np.zeros(1 << (bits - 6), U) if words is None else words

    def spots(self, keys: np.ndarray) -> list[np.ndarray]:
        shift = U(64 - self.bits)
        return [mixed(keys + U(k)) >> shift for k in (101, 202)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in self.spots(keys):
            out &= (self.words[s >> U(6)] >> (s & U(63))) & U(1) == 1
        return out


def repeated_filter(keys: DataFrame) -> Filter:
    """The filter of the keys that occur more than once.

    Each task sets its keys' bits, slices of the bits are ORed on the executors, and the slices, 2 ** FILTER_BITS bits
    together at most, come to the driver once. With more keys than the bits can tell apart the filter passes more.
    """
    twice = stored(keys.groupBy("key").count().where("count > 1").select("key"), "twice")
    bits = min(FILTER_BITS, max(12, math.ceil(math.log2(16 * twice.count() + 1))))
    whole = 1 << (bits - 6)
    slice_words = min(whole, SLICE_WORDS)

    def set_bits(batches):
        own = Filter(bits)
        for batch in batches:
            for s in own.spots(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(own.words, s >> U(6), U(1) << (s & U(63)))
        for at in range(0, whole, slice_words):
            if own.words[at : at + slice_words].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([own.words[at : at + slice_words].tobytes()], pa.binary())], ["at", "words"])

    def ored(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, words in zip(*(c.to_pylist() for c in batch.columns)):
                sums[at] = sums.get(at, U(0)) | np.frombuffer(words, U)
        for at, words in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["at", "words"])

    schema = "at long, words binary"
    out = Filter(bits)
    for r in twice.mapInArrow(set_bits, schema).repartition("at").mapInArrow(ored, schema).toLocalIterator():
        out.words[r["at"] : r["at"] + slice_words] = np.frombuffer(r["words"], U)
    free(twice)
    return out


def keys_of(docs: DataFrame, made) -> DataFrame:
    """(key) rows of made(words)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts]):
                yield pa.RecordBatch.from_arrays([pa.array(made(Words(texts[a:b])).view(np.int64), pa.int64())], ["key"])

    return docs.mapInArrow(run, "key long")


#: Stands for a document in an entry that only tells that a window is repeated.
NO_DOC = 0xFFFFFFFF
#: Blobs between tasks: windows of a block by bucket, repeated windows of a block, and the texts of a block.
BLOBS = {"to": pa.int32(), "block": pa.int64()} | {c: pa.binary() for c in ("key", "more", "doc", "pos", "t1", "t2")}
BLOBS_SCHEMA = "to int, block long, key binary, more binary, doc binary, pos binary, t1 binary, t2 binary"
KINDS = {"key": "<u8", "more": "<u4", "doc": "<u4", "pos": "<u4", "t1": "<i8", "t2": "<i8"}


def arrays(blobs: dict, names: list[str]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, KINDS[c]) for x in blobs[c]]) for c in names]


def runs_of(texts: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text with its positions as runs: the first and the last of each row of neighbours."""
    order = np.lexsort((pos, texts))
    texts, pos = texts[order], pos[order]
    new = np.concatenate([[True], (texts[1:] != texts[:-1]) | (pos[1:] > pos[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    ends = np.stack([pos[first], pos[last]], 1).astype(np.int32)
    own = texts[first]
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[cut], [x.ravel() for x in np.split(ends, cut[1:])]


def window_blobs(docs: DataFrame, levels: Levels, first: Filter, second: Filter, buckets: int) -> DataFrame:
    """The windows of (t1, t2, text) that are candidates at the whole width, as BLOBS.

    A block is what a task compares at once. Windows that it has met twice itself are repeated for sure: they come with
    the block's texts. One entry with their key and NO_DOC tells the other blocks. So a key leaves a block once, however
    often it occurs. The numbers of blocks hold within this one job only.
    """
    shared = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches):
        first, second = shared.value
        ids, held, n, block = [], [], 0, TaskContext.get().partitionId() << 24

        def flush():
            t = np.array(ids, np.int64)
            key, more, doc, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((more, key))
            key, more, doc, pos = key[order], more[order], doc[order], pos[order]
            start = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
            alone = start & np.concatenate([start[1:], [True]])
            yield rows_of(BLOBS, to=[block % buckets], block=[block], t1=[t[:, 0].tobytes()], t2=[t[:, 1].tobytes()], doc=[doc[~alone].tobytes()], pos=[pos[~alone].tobytes()])
            doc = np.where(alone, doc, np.uint32(NO_DOC))
            out = dict(zip(("key", "more", "doc", "pos"), (x[start] for x in (key, more, doc, pos))))
            cut = np.searchsorted(((out["key"] >> U(32)) * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U)).tolist()
            some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
            yield rows_of(BLOBS, to=some, block=[block] * len(some), **{c: [x[cut[i] : cut[i + 1]].tobytes() for i in some] for c, x in out.items()})

        for batch in batches:
            t1, t2, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices([len(t) for t in texts]):
                w = Words(texts[a:b])
                keys, at = levels.anchors(w)
                keys, at = levels.doubled(w, at[first.has(keys)])
                at = levels.whole(w, at[second.has(keys)])
                if len(at):
                    more = (window_hashes(w.h, levels.width, 1)[at] >> U(32)).astype(np.uint32)
                    held.append((window_hashes(w.h, levels.width)[at], more, (w.doc[at] + len(ids)).astype(np.uint32), (at - w.start[at]).astype(np.uint32)))
                    n += len(at)
                    ids += zip(t1[a:b], t2[a:b])
                if n >= HELD:
                    yield from flush()
                    ids, held, n, block = [], [], 0, block + 1
        if held:
            yield from flush()

    return docs.mapInArrow(run, BLOBS_SCHEMA)


def repeated_in_buckets(blobs: DataFrame, buckets: int) -> DataFrame:
    """The windows of each block that other blocks have too, as BLOBS; the blocks' texts pass."""

    def run(batches):
        got = {c: [] for c in ("key", "more", "doc", "pos")}
        blocks = []
        for batch in batches:
            windows = batch.filter(batch["key"].is_valid())
            yield batch.filter(batch["key"].is_null())
            for c in got:
                got[c] += windows[c].to_pylist()
            blocks += windows["block"].to_pylist()
        if blocks:
            block = np.repeat(np.array(blocks, np.int64), [len(x) // 8 for x in got["key"]])
            key, more, doc, pos = arrays(got, list(got))
            order = np.lexsort((more, key))
            key, more, doc, pos, block = key[order], more[order], doc[order], pos[order], block[order]
            same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
            met = (np.concatenate([[False], same]) | np.concatenate([same, [False]])) & (doc != NO_DOC)
            order = np.lexsort((pos[met], doc[met], block[met]))
            block, doc, pos = block[met][order], doc[met][order], pos[met][order]
            own, cut = np.unique(block, return_index=True)
            cut = [*cut.tolist(), len(block)]
            yield rows_of(BLOBS, to=own % buckets, block=own, **{c: [x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for c, x in (("doc", doc), ("pos", pos))})

    return blobs.repartitionById(buckets, "to").mapInArrow(run, BLOBS_SCHEMA)


def runs_by_text(blobs: DataFrame, buckets: int) -> DataFrame:
    """(t1, t2, runs) of each block's texts."""

    def run(batches):
        blocks: dict[int, dict[str, list]] = {}
        for batch in batches:
            for to, block, _, _, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                own = blocks.setdefault(block, {c: [] for c in ("doc", "pos", "t1", "t2")})
                for c, x in zip(own, rest):
                    if x is not None:
                        own[c].append(x)
        for own in blocks.values():
            doc, pos, t1, t2 = arrays(own, list(own))
            if len(doc):
                which, runs = runs_of(doc, pos.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(t1[which]), pa.array(t2[which]), pa.array(runs, pa.list_(pa.int32()))], ["t1", "t2", "runs"])

    return blobs.repartitionById(buckets, "to").mapInArrow(run, "t1 long, t2 long, runs array<int>")


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(t1, t2, runs array<int>): first and last starts of the runs of windows of each text (t1, t2, text) whose words start anywhere else too."""
    levels = Levels(width)
    first = repeated_filter(keys_of(docs, lambda w: levels.anchors(w)[0]))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def second_keys(w):
        keys, at = levels.anchors(w)
        return levels.doubled(w, at[shared.value.has(keys)])[0]

    second = repeated_filter(keys_of(docs, second_keys))
    # a bucket is planned for HELD windows, one for every word at most
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // 6 // HELD)
    blobs = repeated_in_buckets(window_blobs(docs, levels, first, second, buckets), buckets)
    return runs_by_text(blobs, buckets).groupBy("t1", "t2").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def substring_dedup(docs: DataFrame, width: int = WINDOW, text: str = "text", digests: bool = False) -> DataFrame:
    """Remove each word that a repeated window covers.

    Words are runs without ASCII white space, unchanged. A window is `width` consecutive words of one document; it is
    repeated when its words also start anywhere else, in the same document included. Windows are judged on the input.
    Result, one row per input row: the columns of docs, n_words, n_removed and kept (the words that stay, joined by a
    space), or kept_sha256 with digests. A null text counts as empty. Documents shorter than a window keep their words; rows
    that repeat a document repeat its windows. Columns of these names in docs, in any case, are replaced. No rows give no rows.
    """
    last = "kept_sha256" if digests else "kept"
    own = [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_words", "n_removed", last) and not (digests and c == text)]
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    body = F.coalesce(F.col(names[docs.columns.index(text)]), F.lit(""))
    rows = rows.select(*(names[i] for i in own), text_key(body).alias("t"), body.cast("binary").alias("text")).select("*", "t.t1", "t.t2").drop("t")
    found = repeated_windows(rows.select("t1", "t2", "text"), width)
    # copies of a text may be many: one row per text, hot ones apart
    sizes = rows.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("size")).join(found, ["t1", "t2"], "left")
    joined = lookup(rows.withColumn("t", F.struct("t1", "t2")), sizes.select(F.struct("t1", "t2").alias("t"), "size", "runs"), "t", "size", rows.count())
    kept = [names[i] for i in own]
    schema = T.StructType([*(T.StructField(names[i], docs.schema[i].dataType) for i in own), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(last, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            runs = batch.column(len(kept) + 1)
            for a, b in slices([len(t) for t in texts]):
                n, gone, out = [], [], []
                for t, s in zip(texts[a:b], runs.slice(a, b - a)):
                    words = t.split()
                    left = words
                    if s.is_valid:
                        mark = np.zeros(len(words) + 1, np.int64)
                        at = s.values.to_numpy()
                        np.add.at(mark, at[::2], 1)
                        np.subtract.at(mark, at[1::2] + width, 1)
                        left = [w for w, c in zip(words, np.cumsum(mark).tolist()) if not c]
                    n.append(len(words))
                    gone.append(len(words) - len(left))
                    joined = b" ".join(left)
                    out.append(hashlib.sha256(joined).hexdigest() if digests else joined.decode())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in range(len(kept))), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [*kept, "n_words", "n_removed", last]
                )

    return joined.select(*kept, "text", "runs").mapInArrow(run, schema).toDF(*(docs.columns[i] for i in own), "n_words", "n_removed", last)
