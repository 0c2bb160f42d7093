"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import quoted
from .pieces import encoder, slices

#: A chunk ends where the rolling hash of the last 16 bytes has CHUNK_BITS zero bits: about 2 ** CHUNK_BITS bytes apart.
CHUNK_BITS = 9
#: Entries of the shared chunk table that is sent to the tasks; with SHARED_BYTES it bounds the broadcast.
SHARED_CHUNKS = 16_384
#: A longer chunk is never put into the table.
SHARED_BYTES = 4096
#: Pieces kept in a worker's cache, besides the shared chunks and the decoded texts of a batch.
CACHE_PIECES = 300_000
SPACES = b" \t\n\x0b\x0c\r"


def _gear() -> np.ndarray:
    """256 mixed 32-bit numbers, one for each byte value."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cuts(text: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks. They depend on the 16 bytes before them alone, so equal passages get equal chunks."""
    if not text:
        return []
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8):  # after the step the hash covers 2 k bytes
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    hit = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) == 0
    hit[1:] &= ~hit[:-1]  # a run of one byte would be cut everywhere
    ends = (np.flatnonzero(hit) + 1).tolist()
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def split(chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
    """The piece that a chunk's start may cut, its whole pieces, and the piece that its end may cut; None: no space in it."""
    pieces = chunk.split()
    spaced = len(pieces) != 1 or len(pieces[0]) != len(chunk)
    if not spaced:
        return None
    head = pieces.pop(0) if pieces and chunk[0] not in SPACES else b""
    tail = pieces.pop() if pieces and chunk[-1] not in SPACES else b""
    return head, pieces, tail


def joined(parts: list) -> list:
    """Repair the joins: what chunks cut between two white spaces is put together and encoded again.

    parts has bytes (a chunk without white space) or (head, content, tail). The result has bytes, each a piece
    to encode, and the contents in between. A join is re-encoded up to the next white space on both sides, across as
    many chunks as that takes; from there on the ids agree with those of the chunks.
    """
    out, carry = [], b""
    for part in parts:
        if isinstance(part, bytes):
            carry += part
            continue
        head, content, tail = part
        if carry or head:
            out.append(carry + head)
        out.append(content)
        carry = tail
    return [*out, carry] if carry else out


def shared_chunks(docs: DataFrame, path: str, text: str = "text") -> dict[bytes, tuple[bytes, bytes, bytes]]:
    """Chunks that several documents hold, encoded once: digest -> head, ids of the whole pieces, tail.

    The SHARED_CHUNKS most frequent ones; chunks are counted by digest over all documents, then one copy of each
    chosen one is encoded. Chunks beyond the bound are encoded where they stand, with the same ids.
    """

    def digests(batches):
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                found += {digest(c) for c in chunks(t or b"") if len(c) <= SHARED_BYTES}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    raw = docs.select(F.col(text).cast("binary").alias("text"))
    counted = raw.mapInArrow(digests, "digest binary").groupBy("digest").count().where("count > 1")
    chosen = {bytes(r[0]) for r in counted.orderBy(F.desc("count"), "digest").limit(SHARED_CHUNKS).collect()}
    if not chosen:
        return {}
    wanted = docs.sparkSession.sparkContext.broadcast(chosen)

    def contents(batches):
        seen = set()
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                for c in chunks(t or b""):
                    if len(c) <= SHARED_BYTES and (d := digest(c)) in wanted.value and d not in seen:
                        seen.add(d)
                        rows.append((d, c))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*rows) if rows else ((), ()))], ["digest", "chunk"])

    def encoded(batches):
        enc = encoder(path, CACHE_PIECES)
        for batch in batches:
            parts = [(d, split(c)) for d, c in zip(*(x.to_pylist() for x in batch.columns))]
            kept = [(d, p) for d, p in parts if p is not None]
            ids = enc.texts([b" ".join(p[1]) for _, p in kept])
            rows = [(d, p[0], i, p[2]) for (d, p), i in zip(kept, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (zip(*rows) if rows else ((), (), (), ()))], ["digest", "head", "ids", "tail"])

    once = raw.mapInArrow(contents, "digest binary, chunk binary").groupBy("digest").agg(F.max("chunk").alias("chunk"))
    return {bytes(d): (bytes(h), bytes(i), bytes(t)) for d, h, i, t in once.mapInArrow(encoded, "digest binary, head binary, ids binary, tail binary").collect()}


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ids array<int>, n_tokens, decoded string, ids_sha256 and decoded_sha256 to documents.

    The ids are those of the tokenizers library for the file at `path` with add_special_tokens=False, unused
    truncation and padding, and decoded is its decode(ids, skip_special_tokens=False). A file whose tokens don't end at white
    space is refused with an error. A null or empty text has no
    ids and decodes to an empty text. Every row gives one row, repeated rows too; other columns stay, and
    columns of the input with a name of the result are replaced. No rows give no rows.
    """
    return _encode(docs, path, text, ["ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"])


FIELDS = {
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "n_tokens": (T.LongType(), pa.int64()),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def _encode(docs: DataFrame, path: str, text: str, want: list[str]) -> DataFrame:
    own = [c for c in docs.columns if c.lower() not in FIELDS]
    kept = [f"c{i}" for i in range(len(own))]
    rows = docs.select(*map(quoted, own), quoted(text).cast("binary")).toDF(*kept, "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(rows, path, "text"))
    schema = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(c, FIELDS[c][0]) for c in want)])

    def run(batches):
        enc = encoder(path, CACHE_PIECES)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for a, b in slices([len(t or b"") for t in texts]):
                ids = encode_texts(enc, shared.value, [t or b"" for t in texts[a:b]])
                made: dict[str, list] = {c: [] for c in want}
                for i in ids:
                    decoded = enc.decode(i)
                    for c in want:
                        made[c].append(
                            np.frombuffer(i, "<i4") if c == "ids" else len(i) // 4 if c == "n_tokens" else decoded.decode() if c == "decoded" else hashlib.sha256(i if c == "ids_sha256" else decoded).hexdigest()
                        )
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), *(pa.array(made[c], FIELDS[c][1]) for c in want)], [*kept, *want])

    return rows.mapInArrow(run, schema).toDF(*own, *want)


def encode_texts(enc, shared: dict, texts: list[bytes]) -> list[bytes]:
    """Ids of the texts: shared chunks come from the table, the rest piece by piece, and joins are repaired."""
    plans, new = [], set()
    for t in texts:
        parts = []
        for c in chunks(t):
            known = shared.get(digest(c)) if shared and len(c) <= SHARED_BYTES else None
            own = None if known else split(c)
            parts.append((known[0], (True, known[1]), known[2]) if known else c if own is None else (own[0], (False, own[1]), own[2]))
        plan = [(False, [x]) if isinstance(x, bytes) else x for x in joined(parts)]
        for done, x in plan:
            if not done:
                new.update(x)
        plans.append(plan)
    enc.learn(new)
    get = enc.cache.__getitem__
    out = [b"".join(x if done else b"".join(map(get, x)) for done, x in plan) for plan in plans]
    enc.forget_long(new)
    return out


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode(), without moving ids and texts."""
    return _encode(docs.select("doc_id", "text"), path, "text", ["n_tokens", "ids_sha256", "decoded_sha256"]).drop("text")
