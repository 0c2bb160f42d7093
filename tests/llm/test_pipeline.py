"""The pipeline against a plain Python version of its stages."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from fixtures import table
from tokenizers import Tokenizer

import corpus_pipeline
from terralane.llm import line_dedup, toxicity
from terralane.llm.common import stored


def u(*key):
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def shingles(t, width=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups_of(texts):
    """For each text the number of one in its group of near copies."""
    group = list(range(len(texts)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    sets = [shingles(t) for t in texts]
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            group[root(a)] = root(b)
    return [root(k) for k in range(len(texts))]


def test_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    # the trained model itself is tested apart
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id not in bad]
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    voice = groups_of([t for _, t, _ in rows])
    by_line = {}
    for g, (i, t, s) in zip(voice, rows):
        for x in t.split("\n"):
            votes = by_line.setdefault(strip(x), {})
            votes[g] = min(votes.get(g, (i, s)), (i, s))
    sites = {x: {s for _, s in votes.values()} for x, votes in by_line.items()}
    kept = []
    for i, t, s in rows:
        stay = "\n".join(x for x in t.split("\n") if not strip(x) or len(sites[strip(x)]) < line_dedup.MIN_SITES)
        if stay == t or strip(stay):
            kept.append((i, stay, s))
    group = groups_of([t for _, t, _ in kept])
    first = {}
    for g, (i, _, _) in zip(group, kept):
        first[g] = min(first.get(g, i), i)
    kept = [x for g, x in zip(group, kept) if first[g] == x[0]]
    n = Counter(s for _, _, s in kept)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, s in kept:
        mean = len(kept) / len(n) / n[s]
        k, p = 0, math.exp(-mean)
        c = p
        while c <= u(17, i, hashlib.md5(t.encode()).hexdigest(), 1):
            k += 1
            p *= mean / k
            c += p
        ids = np.array(lib.encode(t, add_special_tokens=False).ids, "<u4")
        want += [(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())] * k
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, d).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


@pytest.mark.parametrize("sent", [line_dedup.SENT_LINES, 0])
def test_one_copy_of_a_spread_article_stays(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)
    article = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(8))
    rows = [(30 - i, article.replace(" ", "  ") if i == 3 else article, "en", f"s{i}", len(article)) for i in range(12)]
    # boilerplate under twelve texts of their own, and a document of nothing else
    rows += [(100 + i, " ".join(f"own{i}y{j}" for j in range(12)) + "\nall rights reserved", "en", f"s{i}", 0) for i in range(12)]
    rows += [(200, "all rights reserved", "en", "s1", 19)]
    lines = stored(corpus_pipeline.drop_boilerplate(spark, table(spark, rows), ""))
    assert sorted(r.doc_id for r in lines.collect()) == [*range(19, 31), *range(100, 112)]
    assert not any("reserved" in r.text for r in lines.collect())
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, lines, "").collect()}
    assert sorted(kept) == [19, *range(100, 112)] and kept[19] == article


def test_one_near_copy_of_a_spread_article_stays_whole(spark):
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(12):
        own = words.copy()
        own[10 * i + 3] = f"changed{i}"
        rows.append((40 - i, "\n".join(" ".join(own[15 * k : 15 * k + 15]) for k in range(8)) + ("\n" if i % 2 else "") + "\nall rights reserved", "en", f"s{i}", 0))
    rows += [(100 + i, " ".join(f"own{i}y{j}" for j in range(12)) + "\nall rights reserved", "en", f"s{i}", 0) for i in range(12)]
    lines = stored(corpus_pipeline.drop_boilerplate(spark, table(spark, rows), ""))
    found = {r.doc_id: r.text for r in lines.collect()}
    assert len(found) == 24 and not any("reserved" in t for t in found.values())
    assert all(len(found[40 - i].split()) == 120 for i in range(12))
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_near_copies(spark, lines, "").collect()}
    assert sorted(kept) == [29, *range(100, 112)] and kept[29] == found[29]
