"""Pages of a stored result."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import explore, pages


def test_pages_are_slices_of_the_sorted_whole(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7 % 1000).alias("n"), F.col("id").cast("string").alias("text"))
    check(df, pages.store(df), 7)
    check(df.orderBy(F.desc("n")), pages.store(df.orderBy(F.desc("n"))), 1)


def check(df, result, least_files):
    assert result.count == 1000 and result.files.count() >= least_files
    whole = [(r.n, r.text) for r in df.collect()]
    for number, size in ((0, 10), (3, 77), (12, 77), (13, 77), (0, 5000), (999, 1)):
        rows = pages.page(result, number, size).collect()
        assert [(r.n, r.text) for r in rows] == whole[number * size : (number + 1) * size]
        assert [r.row_number for r in rows] == list(range(1000))[number * size : (number + 1) * size]
    every = sorted((r.row_number, r.page_number, r.n) for r in pages.numbered(result, 77).collect())
    assert every == [(i, i // 77, n) for i, (n, _) in enumerate(whole)]


def test_a_page_reads_only_its_files(spark):
    result = pages.store(spark.range(0, 900, numPartitions=9).select(F.col("id").alias("n")))
    assert len(pages.page(result, 4, 50).inputFiles()) == 1 and len(pages.page(result, 1, 75).inputFiles()) == 2
    assert len(result.spark.read.parquet(result.path).inputFiles()) == 9


def test_empty_result_and_wrong_pages(spark):
    result = pages.store(spark.range(0).select(F.col("id").alias("n")))
    assert result.count == 0 and pages.page(result, 0, 10).collect() == [] and pages.page(result, 0, 10).columns == ["n", "row_number"]
    for number, size in ((-1, 10), (0, 0)):
        with pytest.raises(ValueError):
            pages.page(result, number, size)


def test_pages_of_an_adhoc_query(spark):
    found = explore.adhoc_result(spark, "SELECT id AS n FROM range(100) WHERE id % 2 = 0 ORDER BY id DESC")
    assert found["count"] == 50
    assert [r.n for r in pages.page(found["result"], 1, 20).collect()] == list(range(58, 18, -2))
