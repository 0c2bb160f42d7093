"""Alignment against whole texts through both libraries and byte offsets one by one."""

import collections
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import hard_rows, table
from tokenizers import Tokenizer

from terralane.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A = Tokenizer.from_file(A)
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=B)
#: Bytes of the byte-level characters.
BYTE = {c: b for b in range(256) for c in [chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE else None] if c}
BYTE |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in BYTE.values())}


def piece_bytes(i):
    p = LIB_B.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if LIB_B.is_byte(i) else p.replace("▁", " ").encode()


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


@functools.cache
def one(text):
    """(a ids, b ids, groups, links as (a, b) list, group links) of a text by whole-text encoding; None without tokens."""
    if not text:
        return None
    a = [(i, bytes(BYTE[c] for c in LIB_A.id_to_token(i))) for i in LIB_A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, piece_bytes(i)) for i in LIB_B.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    a, b = spans(a), spans(b)
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    groups = [([i for i, s, e in a if lo <= s and e <= hi], [i for i, s, e in b if lo <= s and e <= hi]) for lo, hi in zip([0, *ends], ends)] if len(raw) < 3000 else None
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return a, b, groups, links


def expected(rows):
    count = collections.Counter(p for _, t in rows if one(t) for p in set(one(t)[3]))
    top = collections.defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, t in rows:
        if not one(t):
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = one(t)
        n_groups = len({e for *_, e in a} & {e for *_, e in b})
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) if groups is not None else None
        best = sum(count[p] == top[p[0]] for p in links)
        out.append((i, len(a), len(b), n_groups, len(links), best, sum(count[p] for p in links), text))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def check(df, rows, digest=True):
    key = lambda r: tuple((x is None, x or 0) for x in r[:-1])
    last = "groups_sha256" if digest else "groups"
    got = sorted((tuple(r[c] for c in [*NAMES, last]) for r in df.collect()), key=key)
    want = sorted(expected(rows), key=key)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert collections.Counter(g[-1] for g, w in zip(got, want) if w[-1] is not None) == collections.Counter(hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] and digest else w[-1] for w in want if w[-1] is not None)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    own = al.Aligner(A, B)
    signs = ["the", " the", "ing", "'s", "  ", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", " ", "é", "é", "日本", "🙂", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "0", "12", "▁", "ﬁ", "\x00", "\x01", ".", "Zx", "---", "﻿", "​"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    counts, groups, links = own.texts(texts)
    for t, c, g, (pair, times) in zip(texts, counts.tolist(), groups, links):
        want = expected([(0, t)])[0]
        assert c[:4] == list(want[1:5]) and g == want[7], t
        assert dict(zip(pair.tolist(), times.tolist())) == collections.Counter(a * own.width + b for a, b in one(t)[3]) if one(t) else not len(pair)


def test_products():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (9, 14)), rng.integers(0, 2, (14, 6))

    def sparse(m):
        return al.Matrix(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), np.nonzero(m)[1], m.shape[1])

    i, j, n = sparse(x).times(sparse(y))
    dense = np.zeros((9, 6), int)
    dense[i, j] = n
    assert (dense == (x > 0).astype(int) @ y).all()
    i, j, _ = sparse(x).transposed().times(sparse(np.eye(9, dtype=int)))
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(x.T))))


def test_documents_by_both_ways(spark):
    rng = random.Random(2)
    words = ["the", "There", "don't", "naïve", "Straße", "x" * 40, "42nd", "▁", "...", "\n\n"]
    rows = hard_rows() + [(20 + i, " ".join(rng.choice(words[: rng.randrange(1, 11)]) for _ in range(30))) for i in range(60)]
    docs = table(spark, rows).withColumnRenamed("lang", "N_A").withColumnRenamed("source", "c0")
    check(al.digests(docs, A, B), rows)
    check(al.digests(docs.repartition(5), A, B, most=0), rows)
    out = al.align(docs, A, B, most=3)
    assert out.columns == ["doc_id", "text", "c0", "n_chars", *al.RESULT]
    check(out, rows, digest=False)
    pairs = {(r.a, r.b): r.n for r in al.id_pairs(docs, A, B).collect()}
    assert pairs == collections.Counter(p for _, t in rows if one(t) for p in set(one(t)[3]))


def test_group_links():
    own = al.Aligner(A, B)
    text = "unbelievably counterintuitive tokenisation, isn't it?"
    counts, groups, _ = own.texts([text])
    sizes = [(x.count(",") + 1, y.count(",") + 1) for x, y in (g.split("|") for g in groups[0].split(";"))]
    assert counts[0, 4] == sum(a * b for a, b in sizes) and counts[0, 2] == len(sizes)


def test_cache_starts_afresh(monkeypatch):
    monkeypatch.setattr(al, "CACHE_UNITS", 3)
    own = al.Aligner(A, B)
    for k in range(5):
        t = f"some words number {k} again"
        counts, groups, _ = own.texts([t])
        assert groups[0] == expected([(0, t)])[0][7]


def test_long_text_and_empty_table(spark):
    long = "abcdefghij" * 200_000  # no white space
    out = al.digests(table(spark, [(1, long), (2, "a" * 5000 + " b")]), A, B).orderBy("doc_id").collect()
    a, b = LIB_A.encode(" " + long, add_special_tokens=False).ids, LIB_B.encode(long)
    assert (out[0].n_a, out[0].n_b) == (len(a), len(b)) and out[1].n_a > 0
    assert al.digests(table(spark, []), A, B).collect() == []
    assert al.digests(table(spark, [(1, None), (2, "")]), A, B, most=-1).select(*NAMES[1:], "groups_sha256").distinct().collect() == [(0, 0, 0, 0, 0, 0, "")]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        al.Tokenizers(public_tokenizers.path("word_bpe_49k.json"), B)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(al.digests(docs, A, B), [(r.doc_id, r.text) for r in docs.collect()])
