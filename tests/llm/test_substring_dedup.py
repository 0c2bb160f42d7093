"""Substring dedup against a count of all windows."""

import collections
import hashlib
import random

import pytest
from fixtures import hard_rows, table

from terralane.llm import substring_dedup as sd


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, width):
    docs = table(spark, rows).select("doc_id", "text", "lang").withColumnRenamed("lang", "n_words")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.substring_dedup(docs, width, digests=True).collect()), key=str)


@pytest.mark.parametrize("seed,width", [(1, 35), (2, 35), (3, 5), (4, 1), (5, 18)])
def test_against_all_windows(spark, seed, width):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" if rng.random() < 0.9 else "the" for i in range(rng.randrange(width, 4 * width + 2))] for k in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(0, 30))]
            p = rng.choice(passages)
            if rng.random() < 0.6:
                a = rng.randrange(len(p))
                w += p[a : a + rng.randrange(len(p) + 1)]
        if rng.random() < 0.2:
            w += ["same"] * rng.randrange(0, 3 * width)
        rows.append((d, "\n ".join(w)))
    want = brute(rows, width)
    assert got(spark, rows, width) == want
    assert sum(w[2] for w in want)


def test_hard_rows(spark):
    assert got(spark, hard_rows(), 35) == brute(hard_rows(), 35)
    assert got(spark, [], 35) == []


def test_kept_text_and_columns(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = table(spark, [(1, "a " + passage + " b"), (2, passage + "  c"), (3, None)])
    out = sd.substring_dedup(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert sorted((r.doc_id, r.kept, r.text) for r in out.collect() if r.text) == [(1, "a b", "a " + passage + " b"), (2, "c", passage + "  c")]
