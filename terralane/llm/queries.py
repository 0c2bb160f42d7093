"""Queries opN_<name> over the whole documents table, and the pipeline, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, exact_dedup, fingerprints, jaccard_join, line_dedup, mixing, quality, spelling, substring_dedup, token_counts, token_files, toxicity


def word_bpe() -> str:
    """The tokenizer file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_docs(spark, sf_dir), word_bpe())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_docs(spark, sf_dir))
    return kept.select("doc_id", "n_chars", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_docs(spark, sf_dir), word_bpe())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces and scores of the 32k piece file, read as a unigram vocabulary."""
    import public_tokenizers

    return token_counts.token_counts(_docs(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_docs(spark, sf_dir), width=4, share="0.85")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_docs(spark, sf_dir).select("doc_id", "text"), digests=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_docs(spark, sf_dir).select("doc_id", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.digests(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_quality": op11_quality, "op13_alignment": op13_alignment, "op12_spelling_variants": op12_spelling_variants, "op10_toxicity": op10_toxicity, "op6_substring_dedup": op6_substring_dedup, "op9_jaccard_join": op9_jaccard_join, "op3_token_files": op3_token_files, "op7_token_counts": op7_token_counts, "op5_mixing": op5_mixing, "op8_line_dedup": op8_line_dedup, "op4_fingerprints": op4_fingerprints, "op1_bpe": op1_bpe, "op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {"op12_spelling_variants": spelling.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op8_line_dedup": line_dedup.ORACLE_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL}
