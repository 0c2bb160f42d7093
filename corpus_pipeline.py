"""Corpus pipeline: stages over the documents table, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from terralane.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from terralane.llm.common import stored
from terralane.llm.queries import word_bpe

#: The columns of documents; all stages but the last return them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows of one Arrow batch. Whole texts are wide rows: Spark's 10,000 of them are held several times on both sides of a Python worker.
BATCH_ROWS = 1000


def narrow_batches(stage):
    """The stage, with the session's Arrow batches bounded for wide rows; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
            spark.conf.set(name, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@narrow_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a toxicity score under 0.5, by a model learned from the labels of these documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


@narrow_batches
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that stand on many sites, near copies of a text counted once; a document that had text and keeps none goes."""
    near = jaccard_join.classed(docs.select("doc_id", "text"), 5, "0.8").select("t1", "t2", "class")
    out = line_dedup.line_dedup(docs.select(*COLUMNS), once="doc_id", near=near)
    return out.where(~((F.col("n_removed") > 0) & F.coalesce(line_dedup.trimmed(F.col("text")) == "", F.lit(True)))).select(*COLUMNS)


@narrow_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that five-word shingles link at a Jaccard likeness of 0.8 or more."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


@narrow_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh the same, and shuffle; the row count stays the same on average."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


@narrow_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the decoded text."""
    return bpe.encode(docs.select(*COLUMNS), word_bpe()).select("doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity model is trained, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
