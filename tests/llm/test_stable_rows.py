"""Results don't depend on how a scan is split, even where that changes between two jobs of one operator."""

import pytest

from terralane.llm import fingerprints, substring_dedup


@pytest.mark.parametrize("run", [lambda d: substring_dedup.substring_dedup(d.select("doc_id", "text"), digests=True), fingerprints.fingerprints])
def test_splits_may_change_between_jobs(spark, run):
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        rows = []
        for planned, collected in ((4, 4), (2, 12)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", planned)
            out = run(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", collected)
            rows.append(sorted(map(str, out.collect())))
        assert rows[0] == rows[1]
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
