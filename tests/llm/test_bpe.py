"""BPE against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from fixtures import hard_rows, table
from tokenizers import Tokenizer

from terralane.llm import bpe, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
ALPHABET = "abcXYZ'stSTllre0129 \t\n\r\x0b\x0c\x1c\x1f\x85  .,!?#<>|/éÉßΣς́ͅİǅﬀ日本🙂ｶﾞ‍​﻿"


def expected(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(30))
def test_pieces_agree_with_library(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 400))) for _ in range(40)]
    enc = pieces.encoder(PATH)
    for t, ids in zip(texts, enc.texts([t.encode() for t in texts])):
        want, decoded = expected(t)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert enc.decode(ids).decode() == decoded


def test_chunks_are_content_defined_and_joins_exact():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 12))) for _ in range(500)]
    text = " ".join(rng.choice(words) for _ in range(4000)).encode()
    found = bpe.chunks(text)
    assert b"".join(found) == text and len(found) > 10
    shifted = set(bpe.chunks(b"other start " + text))
    assert len(shifted & set(found)) >= len(found) - 2
    enc = pieces.encoder(PATH)
    shared = {}
    for c in found[::2]:
        if (p := bpe.split(c)) is not None:
            shared[bpe.digest(c)] = (p[0], enc.texts([b" ".join(p[1])])[0], p[2])
    assert bpe.encode_texts(enc, shared, [text]) == enc.texts([text])


def test_encode_hard_rows(spark):
    rows = hard_rows()
    docs = table(spark, rows).withColumnRenamed("lang", "ids")  # a column whose name clashes is replaced
    got = sorted((r.text or "", list(r.ids), r.n_tokens, r.decoded, r.ids_sha256, r.decoded_sha256, r.doc_id or -1) for r in bpe.encode(docs, PATH).collect())
    want = []
    for i, t in rows:
        ids, decoded = expected(t)
        want.append((t or "", ids, len(ids), decoded, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), i or -1))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bpe.digests(table(spark, []), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH).collect()}
    for r in docs.collect():
        ids, decoded = expected(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


@pytest.mark.parametrize("change", ["normalizer", "prefix", "added", "suffix"])
def test_altered_tokenizer_files_are_refused(tmp_path, change):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        spec = json.load(f)
    if change == "normalizer":
        spec["normalizer"]["normalizers"][1] = {"type": "Replace", "pattern": {"String": "x"}, "content": "y"}
    elif change == "prefix":
        spec["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    elif change == "added":
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": 49408, "content": "new york"})
    else:
        spec["model"]["fuse_unk"] = True
    path = tmp_path / "altered.json"
    path.write_text(json.dumps(spec))
    from terralane.llm.pieces import PieceEncoder

    with pytest.raises(ValueError):
        PieceEncoder(str(path))


def test_odd_column_names(spark):
    docs = table(spark, [(1, "two words"), (2, None)]).selectExpr("doc_id", "text", "lang as `__text`", "source as `a.b`", "n_chars as `IDS`")
    out = bpe.encode(docs.withColumn("x`y", docs["doc_id"]), public_tokenizers.path("word_bpe_49k.json"))
    assert out.columns == ["doc_id", "text", "__text", "a.b", "x`y", "ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {1: 2, 2: 0}
