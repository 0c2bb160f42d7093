"""Quality classifier: random-indexing token vectors of the whole corpus, pooled per document, and a two-layer numpy network."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import quoted, tidy
from .pieces import slices
from .shingles import mixed, span_hashes
from .toxicity import held_out

#: Labelled documents that the network is fit on at most: those whose ids hash lowest.
MAX_TRAIN = 20_000
#: Tokens share SLOTS vectors of DIMS numbers by their hash, whatever the corpus holds; tokens up to REACH apart are neighbours.
SLOTS, DIMS, REACH = 1 << 16, 32, 2
#: Entries of +1 or -1 in a token's random index vector.
ENTRIES = 2
#: Slots of one row of the summed table, and tasks whose rows are added up first.
BLOCK, FAN_IN = 256, 1024
#: One training row in CALIBRATE_OF is kept from the network and sets the temperature.
CALIBRATE_OF = 5
THRESHOLD = 0.3
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 24, 60, 3e-3, 1e-4, 128
U = np.uint64


def _kinds() -> np.ndarray:
    """0 for white space, 1 for letters (all bytes from 0x80 on), 2 for digits, 3 for other signs, by byte."""
    kind = np.full(256, 3, np.int8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[48:58] = 2
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kind


KINDS = _kinds()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in a row, and the number of tokens before each text and after the last.

    A token is a run of letters, of digits or of other signs, in its own case.
    """
    joined = b"\n".join([b"", *texts, b""])
    kind = KINDS[np.frombuffer(joined, np.uint8)]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = edge[:-1], edge[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    return span_hashes(joined, start, end), np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts)]))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(48)).astype(np.int64) % SLOTS


def index_entries(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of the k-th entry of the tokens' random index vectors."""
    h = mixed(hashes + U(0x51ED270B * (k + 1)))
    return (h >> U(40)).astype(np.int64) % DIMS, 1.0 - 2.0 * (h & U(1)).astype(np.float64)


def neighbour_sums(hashes: np.ndarray, first: np.ndarray, total: np.ndarray) -> None:
    """Add to each token's slot the index vectors of the tokens around it in its text; total has SLOTS * DIMS sums."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = slots(hashes) * DIMS
    entries = [index_entries(hashes, k) for k in range(ENTRIES)]
    for apart in range(1, REACH + 1):
        here = np.flatnonzero(text[apart:] == text[:-apart])
        there = here + apart
        for a, b in ((here, there), (there, here)):
            for dim, sign in entries:
                total += np.bincount(at[a] + dim[b], sign[b], minlength=SLOTS * DIMS)


def packed(sums: np.ndarray) -> bytes:
    return zlib.compress(sums.astype(np.int64).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64)


def added(parts: DataFrame) -> DataFrame:
    """Add up the blobs of each (block, part): a stream of sorted rows, one sum in memory."""

    def run(batches):
        at = total = None
        for batch in batches:
            for block, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, part) != at:
                    if at is not None:
                        yield one(*at, total)
                    at, total = (block, part), 0
                total = total + unpacked(blob)
        if at is not None:
            yield one(*at, total)

    def one(block, part, total):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([packed(total)], pa.binary())], ["block", "part", "blob"])

    return parts.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(tidy(run), "block int, part int, blob binary")


def token_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS vectors of length 1 (0 for slots without tokens): sums of the neighbours' index vectors over all documents.

    The sums are whole numbers, so they don't depend on partitions. What leaves a task, and what reaches the driver, is bounded by
    SLOTS * DIMS numbers; tasks are added up in two rounds.
    """

    def summed(batches):
        total = np.zeros(SLOTS * DIMS)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(list(map(len, texts)), 1 << 23):
                neighbour_sums(*tokens(texts[a:b]), total)
        rows = total.reshape(-1, BLOCK * DIMS)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed(rows[i]) for i in used], pa.binary())], ["block", "blob"])

    raw = docs.select(F.coalesce(quoted(text), F.lit("")).cast("binary").alias("text"))
    parts = raw.mapInArrow(tidy(summed), "block int, blob binary").select("block", F.expr(f"int(spark_partition_id() div {FAN_IN})").alias("part"), "blob")
    total = np.zeros((SLOTS // BLOCK, BLOCK * DIMS))
    for r in added(added(parts).withColumn("part", F.lit(0))).collect():
        total[r["block"]] = unpacked(r["blob"])
    total = total.reshape(SLOTS, DIMS)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


#: Pooled features: mean and deviation of the vectors, how well neighbours agree, how often a token's vector is its own
#: index vector's (it stands next to itself), and the logarithm of the number of tokens.
FEATURES = 2 * DIMS + 3


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """FEATURES of each text; a text without tokens has zeros."""
    hashes, first = tokens(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    at, size = first[:-1][full], n[full, None].astype(np.float32)
    v = vectors[slots(hashes)]
    mean = np.add.reduceat(v, at, axis=0) / size
    out[full, :DIMS] = mean
    out[full, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(v * v, at, axis=0) / size - mean * mean, 0))
    beside = np.zeros(len(v), np.float32)
    beside[:-1] = np.einsum("ij,ij->i", v[:-1], v[1:])
    beside[first[1:][full] - 1] = 0  # the last token of a text has no neighbour behind it
    out[full, 2 * DIMS] = np.add.reduceat(beside, at) / size[:, 0]
    own = np.zeros(len(v), np.float32)
    for k in range(ENTRIES):
        dim, sign = index_entries(hashes, k)
        own += v[np.arange(len(v)), dim] * sign
    out[full, 2 * DIMS + 1] = np.add.reduceat(own, at) / size[:, 0]
    out[full, 2 * DIMS + 2] = np.log1p(size[:, 0]) / 10
    return out


@dataclass
class Network:
    """tanh layer and linear layer; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        # einsum, not matmul: a row's sum doesn't depend on the rows beside it
        hidden = np.tanh(np.einsum("ij,jk->ik", (x - self.mean) / self.scale, self.w1) + self.b1)
        return np.einsum("ij,j->i", hidden, self.w2) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on logistic loss by Adam, with fixed seed."""
    rng = np.random.default_rng(11)
    x, y = x.astype(np.float64), y.astype(np.float64)
    net = Network(x.mean(axis=0), x.std(axis=0) + 1e-3, rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), 0.0)
    x = (x - net.mean) / net.scale
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    one, two = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, len(x), BATCH):
            i = order[k : k + BATCH]
            w1, b1, w2, b2 = weights
            hidden = np.tanh(x[i] @ w1 + b1)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -500, 500))) - y[i]) / len(i)
            back = np.outer(wrong, w2) * (1 - hidden**2)
            step += 1
            for j, g in enumerate((x[i].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ wrong + DECAY * w2, wrong.sum(keepdims=True))):
                one[j] = 0.9 * one[j] + 0.1 * g
                two[j] = 0.999 * two[j] + 0.001 * g * g
                weights[j] = weights[j] - rate * (one[j] / (1 - 0.9**step)) / (np.sqrt(two[j] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    return net


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least logistic loss, by golden-section search between 1/8 and 8."""

    def loss(t):
        z = logits / math.exp(t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    lo, hi, part = -math.log(8), math.log(8), (math.sqrt(5) - 1) / 2
    while hi - lo > 1e-4:
        a, b = hi - part * (hi - lo), lo + part * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


@dataclass
class Model:
    vectors: np.ndarray
    #: None where the labels are all of one kind
    network: Network | None
    prior: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.prior) if self.network is None else self.network.score(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Vectors from all documents; the network from labels.quality of at most `most` rows that aren't held out.

    Labels without a document, null labels and null ids count for nothing; of several labels of one id the highest counts, of several
    documents of one id the largest text. Equal texts are all in the network's rows or all in those of the temperature.
    Without labels of both kinds all scores are the share of good ones, (good + 0.5) / (all + 1).
    """
    vectors = token_vectors(docs)
    known = labels.where(~held_out()).where("quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("quality").alias("quality"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                x = pooled(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([zlib.crc32(t) % CALIBRATE_OF for t in part.column(2).to_pylist()], pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "fold", "x"])

    rows = sample.select("doc_id", "quality", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), "doc_id long, quality int, fold int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    shared.unpersist()
    y = np.array([r["quality"] for r in rows], np.float64)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows])
    held = np.array([r["fold"] == 0 for r in rows], bool)
    if len(set(y[~held].tolist())) < 2:
        return Model(vectors, None, prior)
    network = fit(x[~held], y[~held])
    if len(set(y[held].tolist())) == 2:
        network.temperature = temperature(network.logits(x[held]), y[held])
    return Model(vectors, network, prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) by text alone; columns of docs with these names are replaced.

    A null text counts as empty; an empty text gets the score of zeros. Every row gives one row; no rows none.
    """
    own = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    kept = [f"c{i}" for i in range(len(own))]
    rows = docs.select(*map(quoted, own), F.coalesce(quoted(text), F.lit("")).cast("binary")).toDF(*kept, "text")
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a, b in slices(list(map(len, texts))):
                scores = model.score(texts[a:b])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))], [*kept, "score", "predicted"])

    return rows.mapInArrow(tidy(run), schema).toDF(*own, "score", "predicted")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model that is trained on the labels."""
    return score(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
