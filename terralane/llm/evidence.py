"""Which elements of a set occur elsewhere: blocks of hashes that are exchanged by hash range and compared there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy
from .shingles import U, mixed

#: Hashes that a task compares among themselves before it sends them, and that a bucket is planned to hold.
HELD, BUCKET = 1_000_000, 500_000
#: Stands for "some set, and another one too" in place of an id or a tag.
NONE = -(1 << 63)
#: Rows between the two halves of an exchange: blobs of one bucket, or counts; more fields may follow, of rows that only pass.
FIELDS = {"bucket": pa.int32(), "keys": pa.binary(), "ids": pa.binary(), "tags": pa.binary(), "met": pa.binary()}
SCHEMA = "bucket int, keys binary, ids binary, tags binary, met binary"


def buckets_for(elements: float) -> int:
    return 1 + int(elements // BUCKET)


def rows_of(fields: dict, **columns) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in fields.items()], list(fields))


def compared(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, ids and tags in the order of the keys, and which of them stand under a key with more than one tag."""
    order = np.lexsort((tags, keys))
    keys, ids, tags = keys[order], ids[order], tags[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    group = np.cumsum(new) - 1
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][(tags[1:] != tags[:-1]) & ~new[1:]]] = True
    return keys, ids, tags, several[group]


def counted(ids: np.ndarray, buckets: int, fields: dict) -> pa.RecordBatch:
    """The distinct ids with their numbers, as blobs by the id."""
    which, n = np.unique(ids[ids != NONE], return_counts=True)
    order = np.argsort(which % buckets, kind="stable")
    which, n = which[order], n[order]
    to, first = np.unique(which % buckets, return_index=True)
    cut = [*first.tolist(), len(which)]
    return rows_of(fields, bucket=to, ids=[which[i:j].tobytes() for i, j in zip(cut, cut[1:])], met=[n[i:j].astype("<i8").tobytes() for i, j in zip(cut, cut[1:])])


def sent(keys: np.ndarray, ids: np.ndarray, tags: np.ndarray | None, buckets: int, fields: dict) -> Iterator[pa.RecordBatch]:
    """What a task makes of a block: counts for the keys that it has itself met under two tags, and the rest by bucket.

    Of a key met under two tags one entry goes on, to tell the others; so a key that very many sets have leaves a
    block once. A bucket is chosen by the upper 32 bits of a key and told the lower ones: two keys that then look
    alike only weaken the evidence. Without tags the ids are the tags.
    """
    if not len(keys):
        return
    own = tags is None
    keys, ids, tags, met = compared(mixed(keys + U(5)), ids, ids if own else tags)
    yield counted(ids[met], buckets, fields)
    first = met & np.concatenate([[True], keys[1:] != keys[:-1]])
    stay = ~met | first
    ids, tags, keys = np.where(first, NONE, ids)[stay], np.where(first, NONE, tags)[stay], keys[stay]
    bucket = ((keys >> U(32)) * U(buckets)) >> U(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U)).tolist()
    some = [i for i in range(buckets) if cut[i] < cut[i + 1]]
    blobs = {"keys": keys.astype("<u4"), "ids": ids} | ({} if own else {"tags": tags})
    yield rows_of(fields, bucket=some, **{c: [x[cut[i] : cut[i + 1]].tobytes() for i in some] for c, x in blobs.items()})


def met(rows: DataFrame, buckets: int, kept: dict | None = None, kept_schema: str = "") -> DataFrame:
    """From rows made by sent(): blobs that count how many of an id's keys stand under another tag too, for summed(). Rows of `kept` fields pass."""
    fields = (kept or {}) | {"bucket": pa.int32(), "ids": pa.binary(), "met": pa.binary()}

    def run(batches):
        keys, ids, tags = [], [], []
        for b in batches:
            blobs = b.filter(b["keys"].is_valid())
            yield b.filter(b["keys"].is_null()).select(list(fields))
            for at, k, i, t in zip(*(blobs[c].to_pylist() for c in ("bucket", "keys", "ids", "tags"))):
                keys.append((U(at) << U(32)) | np.frombuffer(k, "<u4").astype(U))
                ids.append(np.frombuffer(i, np.int64))
                tags.append(np.frombuffer(i if t is None else t, np.int64))
        if keys:
            _, i, _, several = compared(*(np.concatenate(x) for x in (keys, ids, tags)))
            yield counted(i[several], buckets, fields)

    return rows.repartitionById(buckets, "bucket").mapInArrow(tidy(run), f"{kept_schema}bucket int, ids binary, met binary")


def summed(blobs: DataFrame, buckets: int) -> DataFrame:
    """(id, met) of the blobs of met(), one row an id; ids that are never met are left out."""

    def run(batches):
        ids, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in batches:
            for out, column in ((ids, b.column(1)), (n, b.column(2))):
                out += [np.frombuffer(x, np.int64) for x in column.to_pylist()]
        which, at = np.unique(np.concatenate(ids), return_inverse=True)
        total = np.zeros(len(which), np.int64)
        np.add.at(total, at, np.concatenate(n))
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total)], ["id", "met"])

    return blobs.select("bucket", "ids", "met").repartitionById(buckets, "bucket").mapInArrow(tidy(run), "id long, met long")
