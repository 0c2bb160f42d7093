"""Toxicity: the grammar's contexts, learning, and held-out accuracy."""

import random

from fixtures import hard_rows, table
from pyspark.sql import functions as F

from terralane.llm import toxicity as tx


def sums(text, weights={"=fool": 3.0}):
    return dict(zip(tx.FIELDS, tx.Grammar(dict(weights)).sums(text)))


def test_contexts_of_a_match():
    plain = sums("what a fool, he ran")
    assert plain["plain"] > 0 and not plain["negated"] and not plain["reported"] and plain["share"] == 0.5
    assert sums("this is not a Fool.")["negated"] > 0
    assert sums("never mind. a fool")["plain"] > 0  # the clause has ended
    assert sums("not one of them was here a fool")["plain"] > 0  # too far
    assert sums("she said fool")["reported"] > 0
    assert sums("you fool!!")["aimed"] > 0
    assert sums("they kill you")["threats"] > 0 and not sums("they never kill")["threats"]
    assert not any(sums("").values()) and not any(sums("foolish words").values())
    assert sums("foolish words", {"^fool": 1.0})["plain"] > 0


def made(n=1500):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}x" for _ in range(800)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobtel", "Grobtan,", "grobtus", "snurf!"]))
        rows.append((i, " ".join(w)))
        if i % 2 or i < 1000:
            labels.append((i, int(toxic)))
    return rows, labels


def test_learns_stems_and_generalises(spark):
    rows, labels = made()
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in tx.toxicity(docs, known).collect()}
    assert len(out) == len(rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    truth = {i: int("grobt" in t.lower() or "snurf" in t) for i, t in rows}
    held = [i for i, r in out.items() if r.held_out]
    assert sum(out[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in out.values())


def test_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = made(600)
    docs, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r.doc_id: r.score for r in tx.toxicity(docs, x).collect()} for x in (known, turned))
    assert a == b


def test_hard_rows_and_missing_labels(spark):
    rows = hard_rows()
    docs = table(spark, rows).withColumnRenamed("lang", "score")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tx.toxicity(docs, none).collect()
    assert len(out) == len(rows) and {r.score for r in out} == {0.5}
    one = spark.createDataFrame([(8, 0), (9, None), (None, 1), (8, 0), (777, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in tx.toxicity(docs, one).collect()} == {0}
    assert tx.toxicity(table(spark, []), none).collect() == []


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = tx.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    right = out.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("a")).collect()
    assert all(r.a > 0.9 for r in right)
