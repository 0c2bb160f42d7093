"""Token-id files: blocks coded by a static range asymmetric numeral system with one shared frequency table."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import shared_dir, with_row_id
from .pieces import encoder, slices

#: log2 of the sum of the quantised frequencies; vocabularies must have fewer ids.
PRECISION = 20
#: States lie in [LOW, LOW << 32); they give and take 32 bits at a time.
LOW = np.uint64(1 << 31)
#: Interleaved coders of a full block, each with every LANES-th id.
LANES = 1024
#: A block takes whole documents until it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Steps (of LANES ids) between two checkpoints, from each of which a decoder can start.
CHECKPOINT_STEPS = 128
BLOCK_FIELDS = "part int, seq long, start long, lanes int, n_ids long, doc_ids array<long>, lengths array<long>, states binary, words binary, offsets array<long>, checksums array<long>"


def quantised(counts: dict[int, int], precision: int = PRECISION) -> dict[int, int]:
    """Frequencies that sum to 2 ** precision, at least 1 for each id that occurs."""
    total, room = sum(counts.values()), 1 << precision
    if len(counts) > room:
        raise ValueError("more ids than the precision can tell apart")
    out = {i: max(1, n * room // total) for i, n in counts.items()}
    left = room - sum(out.values())
    for i in sorted(out, key=lambda i: (-out[i], i)):  # the most frequent ids take what rounding left
        step = left if left > 0 else max(left, 1 - out[i])
        out[i] += step
        left -= step
        if not left:
            break
    return out


class Coder:
    """Encodes and decodes arrays of ids with a frequency table that all blocks share."""

    def __init__(self, table: dict[int, int], precision: int = PRECISION):
        self.bits = np.uint64(precision)
        size = max(table, default=0) + 1
        self.freq = np.zeros(size, np.uint64)
        for i, f in table.items():
            self.freq[i] = f
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))
        self.limit = self.freq << (np.uint64(63) - self.bits)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[bytes, bytes, list[int]]:
        """States at each checkpoint, the words, and the word at which each checkpoint starts."""
        steps = -(-len(ids) // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        states: list[bytes] = []
        ends: list[int] = []
        written = 0
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            y, f = x[: len(s)], self.freq[s]
            full = y >= self.limit[s]
            out = y[full].astype("<u4")
            words.append(out)
            written += len(out)
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: len(s)] = (q << self.bits) + self.cum[s] + (y - q * f)
            if t % CHECKPOINT_STEPS == 0:
                states.append(x.astype("<u8").tobytes())
                ends.append(written)
        offsets = [written - e for e in reversed(ends)]
        return b"".join(reversed(states)), b"".join(w.tobytes() for w in reversed(words)), offsets

    def decode(self, states: bytes, words: bytes, offsets: list[int], n: int, lanes: int, segment: int | None = None) -> np.ndarray:
        """All ids, or those between one checkpoint and the next."""
        if not n:
            return np.empty(0, np.uint32)
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        steps = -(-n // lanes)
        first, last = (0, steps) if segment is None else (segment * CHECKPOINT_STEPS, min(steps, (segment + 1) * CHECKPOINT_STEPS))
        k = segment or 0
        x = np.frombuffer(states, "<u8", lanes, k * lanes * 8).astype(np.uint64)
        at, out = offsets[k], []
        mask = (np.uint64(1) << self.bits) - np.uint64(1)
        for t in range(first, last):
            width = min(lanes, n - t * lanes)
            y = x[:width]
            slot = y & mask
            s = self.symbol[slot]
            out.append(s)
            y = self.freq[s] * (y >> self.bits) + slot - self.cum[s]
            short = np.flatnonzero(y < LOW)
            y[short] = (y[short] << np.uint64(32)) | stream[at : at + len(short)]
            at += len(short)
            x[:width] = y
        return np.concatenate(out)


def segments(ids: np.ndarray, lanes: int) -> list[int]:
    """crc32 of the ids between each two checkpoints."""
    raw, step = ids.astype("<u4").tobytes(), lanes * CHECKPOINT_STEPS * 4
    return [zlib.crc32(raw[a : a + step]) for a in range(0, len(raw), step)]


def ordered_ids(docs: DataFrame, path: str, end_id: int, parts: int) -> DataFrame:
    """(part, seq, doc_id, n, ids) in ascending doc_id order: part after part, seq = ids of the part before the document."""
    rows = with_row_id(docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("p")).first()["p"] or [])) if parts > 1 else []

    def number(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") <= bounds[mid], number(lo, mid)).otherwise(number(mid + 1, hi))

    part = F.when(F.col("doc_id").isNull(), 0).otherwise(number(0, len(bounds)))
    rows = rows.withColumn("part", part).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "__row")

    def encoded(batches):
        enc, now, seq = encoder(path), None, 0
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            part, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices([len(t) for t in texts]):
                coded = [x + tail for x in enc.texts(texts[a:b])]
                seqs = []
                for p, x in zip(part[a:b], coded):
                    if p != now:
                        now, seq = p, 0
                    seqs.append(seq)
                    seq += len(x) // 4
                columns = [pa.array(part[a:b], pa.int32()), pa.array(seqs, pa.int64()), pa.array(ids[a:b], pa.int64()), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([packed(x) for x in coded], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "n", "ids"])

    return rows.select("part", "doc_id", "text").mapInArrow(encoded, "part int, seq long, doc_id long, n long, ids binary")


def packed(ids: bytes) -> bytes:
    """The low and then the high halves of the ids, the high ones only where some id needs them."""
    a = np.frombuffer(ids, "<u4")
    return a.astype("<u2").tobytes() if not len(a) or a.max() < 1 << 16 else (a & 0xFFFF).astype("<u2").tobytes() + (a >> 16).astype("<u2").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(raw, "<u2").astype(np.uint32)
    return a if len(a) == n else a[:n] | (a[n:] << np.uint32(16))


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1, parts: int | None = None) -> str:
    """Write the ids of documents, each with end_id behind them, as block files in ascending doc_id order; gives `out`.

    Under `out`, table/ has the frequency table (id, frequency) and blocks/ the blocks: part and seq order them, start
    is the number of ids before the block, doc_ids and lengths tell its documents, states, words and offsets
    have the coders' state at each checkpoint, the coded words and the word at which a checkpoint starts, and checksums
    the crc32 of the ids between checkpoints. A null text counts as empty and has the end id alone. A null doc_id
    comes first; rows that repeat a doc_id stand in the order read. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered_ids(docs, path, end_id, parts).write.option("compression", "zstd").parquet(f"{out}/ids")
    ids = spark.read.parquet(f"{out}/ids")

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.bincount(unpacked(raw, n))
                if len(c) > len(total):
                    total, c = c, total
                total[: len(c)] += c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    # at most one row for each id of the vocabulary, and for each part
    counts = ids.select("ids", "n").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = quantised({r["id"]: r["n"] for r in counts.collect()})
    spark.createDataFrame(sorted(table.items()), "id long, frequency long").coalesce(1).write.parquet(f"{out}/table")
    starts, before = {}, 0
    for r in sorted(ids.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[r["part"]], before = before, before + r["n"]
    coders = {}
    shared = spark.sparkContext.broadcast((table, starts))

    def blocks(batches):
        table, starts = shared.value
        coder = coders.setdefault("own", Coder(table))
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (size + row[3] > BLOCK_IDS or row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][3]):
                    yield block(coder, starts, held)
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield block(coder, starts, held)

    ids.select("part", "seq", "doc_id", "n", "ids").mapInArrow(blocks, BLOCK_FIELDS).write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def block(coder: Coder, starts: dict, rows: list[tuple]) -> pa.RecordBatch:
    part, seq = rows[0][:2]
    ids = np.concatenate([unpacked(r[4], r[3]) for r in rows])
    lanes = min(LANES, max(1, len(ids) // 64))
    states, words, offsets = coder.encode(ids, lanes)
    values = [part, seq, starts[part] + seq, lanes, len(ids), [r[2] for r in rows], [r[3] for r in rows], states, words, offsets, segments(ids, lanes)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in BLOCK_FIELDS.split(", ")])


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids array<int> of each document of block files, or ids_crc32 in place of the ids.

    Blocks are decoded independently, each against its checksums; a block that differs raises an error.
    """
    table = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/table").collect()}
    shared = spark.sparkContext.broadcast(table)

    def decoded(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for r in batch.to_pylist():
                ids = coder.decode(r["states"], r["words"], r["offsets"], r["n_ids"], r["lanes"])
                if segments(ids, r["lanes"]) != r["checksums"]:
                    raise ValueError(f"block {r['part']}/{r['seq']} is damaged")
                cut = np.cumsum([0, *r["lengths"]]).tolist()
                own = [ids[a:b] for a, b in zip(cut, cut[1:])]
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([r["start"] + a for a in cut[:-1]], pa.int64()), pa.array(r["lengths"], pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    kind = "ids_crc32 long" if digest else "ids array<int>"
    return spark.read.parquet(f"{path}/blocks").mapInArrow(decoded, f"doc_id long, start long, n_tokens long, {kind}")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    return read_ids(spark, write_ids(docs, path, f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"), digest=True)
