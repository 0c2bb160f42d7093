"""Fingerprints against exact likeness and Python's own edit."""

import hashlib
import re

import xxhash
from fixtures import hard_rows, table

from terralane.llm import fingerprints as fp


def shingles(t, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def like(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def key(t):
    """The first half of the text key, as a signed number."""
    return int.from_bytes(xxhash.xxh64((t or "").encode(), seed=42).intdigest().to_bytes(8), signed=True)


def hold(rows, got, most=0.15):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1])), reverse=True)
    texts = [t or "" for _, t in order]
    want = [(i, t, u) for (i, _), t, u in zip(order, texts, texts[1:] + texts[:1])]
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in got}
    prints = {}
    for i, t, u in want:
        e = edited(t, u)
        r = got[i, len(t), hashlib.sha256(e.encode()).hexdigest()]
        assert abs(r.near_edited - like(t, e)) <= most and abs(r.near_next - like(t, u)) <= most
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert abs(r.n_shingles - len(shingles(t))) <= max(2, 0.3 * len(shingles(t)))


def test_hard_rows(spark):
    rows = hard_rows()
    out = fp.fingerprints(table(spark, rows)).collect()
    assert len(out) == len(rows)
    hold(rows, out)


def test_whole_table_over_many_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = fp.fingerprints(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(out) == len(rows)
    hold(rows, out)


def test_one_and_no_document(spark):
    assert fp.fingerprints(table(spark, [])).collect() == []
    (r,) = fp.fingerprints(table(spark, [(3, "a b c d e f")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_merged_parts_are_the_whole(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i * i % 997}" for i in range(3000))
    words = text.split()
    parts = [(1, " ".join(words[i : i + 104])) for i in range(0, len(words) - 4, 100)]
    whole = fp.with_sketch(table(spark, [(1, text)]), "text", "kept").first().kept
    cut = fp.with_sketch(table(spark, parts), "text", "kept")
    assert fp.merge_sketches(cut, "doc_id", fan_in=4).first().kept == whole
    assert fp.merge_sketches(cut.where(F.lit(False)), "doc_id").collect() == []
