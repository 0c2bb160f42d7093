"""Token counts against the tokenizers library's Unigram model."""

import random

import public_tokenizers
import pytest
from fixtures import hard_rows, table
from tokenizers import Tokenizer, models, pre_tokenizers

from terralane.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(vocab, byte_fallback=True):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tc.MARK, prepend_scheme="always", split=True)
    return t


LIB = library(tc.vocabulary(PATH))


def expected(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(20))
def test_random_texts(seed):
    rng = random.Random(seed)
    own = tc.counter(PATH)
    for _ in range(60):
        text = "".join(rng.choice("aaabbcdeesttthe   .,-ÄéßΣ日本🙂\n\t▁<>0x") for _ in range(rng.randrange(0, 120)))
        assert own.text(text) == expected(text), text


@pytest.mark.parametrize("seed", range(10))
def test_ties(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(30)}
    vocab = [("<unk>", 0.0), *((p, float(-rng.randrange(1, 4))) for p in sorted(pieces))]
    own, lib = tc.Counter(vocab), library(vocab, False)
    for _ in range(100):
        text = "".join(rng.choice("aabb c") for _ in range(rng.randrange(1, 30)))
        assert own.text(text) == len(lib.encode(text, add_special_tokens=False).ids), text


def test_hard_rows(spark):
    rows = hard_rows()
    got = sorted((r.text or "", r.n_tokens) for r in tc.token_counts(table(spark, rows).withColumnRenamed("n_chars", "n_tokens"), PATH).collect())
    assert got == sorted((t or "", expected(t)) for _, t in rows)
    assert tc.token_counts(table(spark, []), PATH).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in tc.token_counts(docs, PATH).collect():
        assert r.n_tokens == expected(r.text)


def test_long_words_take_little_memory():
    import tracemalloc

    own = tc.counter(PATH)
    word = "abé日thing" * 250_000
    assert own.count(tc.MARK + word[:9000]) == expected(word[:9000])
    tracemalloc.start()
    n = own.count(word)
    # the automaton's copy of the word, four bytes a character, and little else
    assert tracemalloc.get_traced_memory()[1] < 5 * len(word) and n > 250_000
    tracemalloc.stop()


def test_odd_column_names(spark):
    docs = table(spark, [(1, "two words"), (2, None)]).selectExpr("doc_id", "text", "lang as `__text`", "source as `a.b`", "n_chars as N_TOKENS")
    out = tc.token_counts(docs, PATH)
    assert out.columns == ["doc_id", "text", "__text", "a.b", "n_tokens"] and {r.doc_id: r.n_tokens for r in out.collect()} == {1: expected("two words"), 2: 0}
