"""Spelling variants against a deletion dictionary in plain Python."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import hard_rows, table

from terralane.llm import spelling as sp


def words_of(rows):
    found = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                found[w] += 1
    return {w: n for w, n in found.items() if n >= 2}


def near(a, b):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(counts):
    links = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and near(v, w)] for w in counts}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 10 * counts[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(links[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def rows_of(df):
    out = df.collect()
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(500)}
    counts = {w: rng.choice([2, 3, 20, 30, 300, 4000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = expected(counts)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] for v in want.values() if v[0])
    assert rows_of(sp.variants(df)) == want
    assert rows_of(sp.variants(df.repartition(7))) == want


def test_runs_of_one_letter_and_ties(spark):
    counts = {"a" * n: 10**k for k, n in enumerate(range(7, 12))} | {"bbbbbbbc": 20, "bbbbbbbd": 20, "bbbbbbb": 2, "bbbbbbbbb": 20}
    got = rows_of(sp.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == expected(counts)
    assert got["bbbbbbb"][0] == "bbbbbbbc" and got["a" * 7][1] == "a" * 11


def test_large_groups_and_long_words(spark):
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    # one part differs: a single key holds a third of the words, more than a block
    words = {"stem" + "".join(rng.choice(letters) for _ in range(2)) + "endings" for _ in range(700)}
    words |= {"".join(rng.choice(letters) for _ in range(9)) for _ in range(1400)}
    long = "".join(rng.choice(letters) for _ in range(3_000))
    words |= {long, long[:500] + long[501:], long[:-1] + "0", "x" + long}
    counts = {w: rng.randrange(2, 100) for w in words}
    assert rows_of(sp.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == expected(counts)


def test_documents(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeABÉé×") for _ in range(rng.randrange(6, 12))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(stems) for _ in range(60)) + "x1Y-zĀ") for i in range(120)] + hard_rows() + [(9, "z" * 300_000)] * 2
    docs = table(spark, rows).withColumnRenamed("source", "word").withColumnRenamed("lang", "n")
    assert rows_of(sp.spelling_variants(docs)) == expected(words_of(rows))
    assert any(zlib.crc32(f"{i}:{s.lower()}".encode()) % 31 == 0 for i in range(120) for s in stems)


def test_empty(spark):
    assert sp.spelling_variants(table(spark, [])).collect() == []
    assert sp.spelling_variants(table(spark, [(1, None), (2, ""), (3, "short words")])).collect() == []
    assert sp.variants(spark.createDataFrame([(None, 3), ("lonely word", 2)], "word string, n long")).collect()[0].root == "lonely word"


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(sp.spelling_variants(docs)) == expected(words_of([(r.doc_id, r.text) for r in docs.collect()]))


def test_sql_gives_the_same_rows(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = {r[0]: tuple(r[1:]) for r in c.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({sp.ORACLE_SQL})").fetchall()}
    assert rows_of(sp.spelling_variants(spark.read.parquet(path))) == want


def test_tiles_meet_each_pair_once():
    first, end = np.array([0, 3, 4, 10]), np.array([3, 4, 10, 1010])
    seen = collections.Counter((int(a), int(b)) for x, y in sp.tiles(first, end) for a, b in zip(x, y))
    assert set(seen.values()) == {1} and len(seen) == 3 + 15 + 1000 * 999 // 2
