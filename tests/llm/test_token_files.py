"""Token files against the library's ids and an exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import hard_rows, table
from tokenizers import Tokenizer

from terralane.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n,lanes", [(0, 1), (1, 1), (7, 3), (1000, 8), (5000, 16), (300_000, 1024)])
def test_coder(n, lanes):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
    values, counts = np.unique(np.concatenate([ids, [5, 9]]), return_counts=True)
    coder = tf.Coder(tf.quantised(dict(zip(values.tolist(), counts.tolist()))))
    states, words, offsets = coder.encode(ids, lanes)
    assert (coder.decode(states, words, offsets, n, lanes) == ids).all()
    for k in range(len(offsets)):
        step = lanes * tf.CHECKPOINT_STEPS
        assert (coder.decode(states, words, offsets, n, lanes, k) == ids[k * step : (k + 1) * step]).all()
    if n == 300_000:
        p = counts / counts.sum()
        assert len(words) * 8 < n * -(p * np.log2(p)).sum() * 1.01 + 4096


def test_quantised_fits():
    for counts in ({1: 1}, {i: 1 for i in range(5000)}, {1: 10**9, **{i: 1 for i in range(2, 3000)}}):
        q = tf.quantised(counts)
        assert sum(q.values()) == 1 << tf.PRECISION and min(q.values()) >= 1


def hold(rows, got):
    order = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    at, want = 0, []
    for _, (i, t) in order:
        ids = np.array([*LIB.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_hard_rows(spark, tmp_path):
    rows = hard_rows()
    docs = table(spark, rows).withColumnRenamed("lang", "part")
    hold(rows, [tuple(r) for r in tf.round_trip(docs, PATH).collect()])
    out = tf.write_ids(docs, PATH, f"file://{tmp_path}/ids")
    got = tf.read_ids(spark, out).collect()
    hold(rows, [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got])


def test_empty_table(spark):
    assert tf.round_trip(table(spark, []), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hold([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in tf.round_trip(docs, PATH).collect()])
