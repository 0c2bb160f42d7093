"""The Jaccard join against all pairs."""

import itertools
import random

import pytest
from fixtures import hard_rows, table

from terralane.llm import jaccard_join as jj


def shingles(t, width):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            group[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def got(spark, rows, width, share):
    return sorted([tuple(r) for r in jj.components(table(spark, rows).withColumnRenamed("n_chars", "key"), width, share).collect()], key=str)


def near_rows(seed, n=60, most=300):
    """Texts of all lengths with copies at and around the limit."""
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 13, 40, rng.randrange(1, most)]))]
        rows.append(base)
        for _ in range(rng.randrange(0, 6)):
            c = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                k = rng.randrange(len(c) + 1)
                c[k : k + rng.randrange(2)] = [f"w{rng.randrange(5000)}"] * rng.randrange(2)
            rows.append(c)
    rng.shuffle(rows)
    return [(i * 3, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed,width,num,den,share", [(1, 4, 17, 20, "0.85"), (2, 5, 4, 5, "0.8"), (3, 1, 1, 2, "0.5")])
def test_against_all_pairs(spark, seed, width, num, den, share):
    rows = near_rows(seed)
    want = brute(rows, width, num, den)
    assert got(spark, rows, width, share) == want
    assert len({w[2] for w in want}) < len(rows) - 10


def test_trees_of_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(jj, "NODE", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(60)]
    rows = []
    for i in range(70):
        c = list(base)
        for _ in range(rng.randrange(0, 4)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(c)))
    assert got(spark, rows, 4, "0.85") == brute(rows, 4, 17, 20)


def test_linked_sets_share_a_key():
    import numpy as np

    rng = np.random.default_rng(3)
    rule = jj.Linking(17, 20)
    for n in [*range(1, 60), 200, 1000]:
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        for _ in range(20):
            extra = rng.integers(0, 1 + n // 5)
            b = np.unique(np.concatenate([a[rng.random(n) > 0.07], rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and rule.linked(common, len(a), len(b)):
                assert len(np.intersect1d(jj.part_keys(a, rule), jj.part_keys(b, rule)))


def test_hard_rows(spark):
    rows = hard_rows()
    assert got(spark, rows, 4, "0.85") == brute(rows, 4, 17, 20)
    assert got(spark, [], 4, "0.85") == []


def test_keep_one(spark):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (7, "other"), (8, ""), (9, "")]
    docs = table(spark, rows)
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, "A b c d e f"), (7, "other"), (8, ""), (9, "")], key=str)
