"""Where queries get their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The Parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
