"""Quality: the vectors and pools against plain loops, the network's calibration, and held-out accuracy."""

import random
import re
import zlib

import numpy as np
from fixtures import hard_rows, table
from pyspark.sql import functions as F

from terralane.llm import quality as q

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def one(token):
    """Hash of a token by itself."""
    return q.tokens([token])[0]


def index_vector(token):
    out = np.zeros(q.DIMS)
    for k in range(q.ENTRIES):
        dim, sign = q.index_entries(one(token), k)
        out[dim[0]] += sign[0]
    return out


def plain_vectors(texts):
    total = np.zeros((q.SLOTS, q.DIMS))
    for t in texts:
        found = TOKEN.findall(t)
        for i, w in enumerate(found):
            for j in range(max(0, i - q.REACH), min(len(found), i + q.REACH + 1)):
                if i != j:
                    total[q.slots(one(w))[0]] += index_vector(found[j])
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def plain_pool(text, vectors):
    found = TOKEN.findall(text)
    if not found:
        return np.zeros(q.FEATURES)
    v = np.array([vectors[q.slots(one(w))[0]] for w in found], np.float64)
    beside = sum(float(a @ b) for a, b in zip(v, v[1:])) / len(v)
    own = sum(float(a @ index_vector(w)) for a, w in zip(v, found)) / len(v)
    return np.concatenate([v.mean(axis=0), v.std(axis=0), [beside, own, np.log1p(len(v)) / 10]])


def test_vectors_and_pools(spark):
    texts = [(t or "").encode() for _, t in hard_rows() if len(t or "") < 2000] + [b"a a a a", b"x", b"Ab!! ab12 ab!!\x0bcd"]
    docs = table(spark, [(i, t.decode()) for i, t in enumerate(texts)])
    want = plain_vectors(texts)
    got = q.token_vectors(docs)
    assert np.allclose(got, want, atol=1e-6)
    assert (q.token_vectors(docs.repartition(5)) == got).all()
    for t, x in zip(texts, q.pooled(texts, got)):
        assert np.allclose(x, plain_pool(t, got), atol=1e-4), t
        assert (q.pooled([t], got)[0] == x).all() or np.allclose(q.pooled([t], got)[0], x, atol=1e-6)


def test_large_tables_of_parts(spark, monkeypatch):
    monkeypatch.setattr(q, "FAN_IN", 2)
    docs = table(spark, [(i, f"w{i % 7} and w{i % 5} again") for i in range(200)])
    assert (q.token_vectors(docs.repartition(9)) == q.token_vectors(docs.coalesce(1))).all()


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20000)
    y = (rng.random(20000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(q.temperature(z * 3, y) - 3) < 0.2 and abs(q.temperature(z / 2, y) - 0.5) < 0.05


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = q.fit(x, y)
    assert ((net.score(x) >= 0.5) == y).mean() > 0.9


def made(n=900):
    rng = random.Random(4)
    words = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.3
        rows.append((i, " ".join([x + rng.choice(["&&&", "%%%"]) for x in w] if bad and i % 2 else [w[0]] * 30 if bad else w) + "."))
        labels.append((i, int(not bad)))
    return rows, labels


def test_learns_signs_and_repetition(spark):
    rows, labels = made()
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in q.quality(docs, known).collect()}
    truth = dict(labels)
    assert len(out) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out.values())
    turned = known.withColumn("quality", F.when(q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    again = {r.doc_id: r.score for r in q.quality(docs.repartition(3), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in out.items())


def test_hard_rows_and_missing_labels(spark):
    rows = [*hard_rows(), (50, "word " * 400_000), (51, "x" * 2_000_000)]
    docs = table(spark, rows).withColumnRenamed("lang", "Score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = q.quality(docs, none).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    odd = spark.createDataFrame([(8, 1), (9, None), (None, 1), (8, 0), (777, 0)], "doc_id long, quality int")
    model = q.train(docs, odd)
    assert model.network is None and model.prior == 0.75
    assert q.score(docs, model).columns == ["doc_id", "text", "source", "n_chars", "score", "predicted"]
    assert q.quality(table(spark, []), none).collect() == []


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = q.quality(docs, labels).join(labels, "doc_id").where("held_out")
    right = {r.quality: r.a for r in out.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a")).collect()}
    assert right[1] > 0.99 and right[0] > 0.9
