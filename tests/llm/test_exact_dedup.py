"""Exact dedup against a group-by in Python."""

import hashlib

from fixtures import hard_rows, table

from terralane.llm import exact_dedup as ed


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_against_groups(spark, monkeypatch):
    monkeypatch.setattr(ed, "FAN_IN", 2)
    rows = hard_rows() + [(i, f"Copy {i % 3}" if i % 2 else f"cOPY {i % 3}") for i in range(100, 160)] + [(900, "ÄÖ"), (901, "äö"), (902, "x" * 200_000), (903, "X" * 200_000)]
    docs = table(spark, rows).repartition(7).withColumnsRenamed({"lang": "digest", "source": "keep_id", "n_chars": "node"})
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, best[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=str)
    out = ed.exact_dedup(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    # one row of each group stays, and it has the id that stays
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert ed.exact_dedup(table(spark, [])).collect() == []
