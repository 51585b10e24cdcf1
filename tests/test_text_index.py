"""Indexed text search against the scan."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import explore, pages, text_index

ROWS = [("Alpha beta", 1, None), ("ALPHABET", 2, 1.5), ("été Über", 3, 2.0), (None, None, None), ("ab", 4, -0.5), ("", 5, 0.0), ("aaaa", 6, 1e10), ("a%b_c\\d", 7, 2.0)]
TERMS = ["alpha", "ALPHA BETA", "lphabet 2", "aaa", "aaaa 6", "zzz", "ab", "a", "", "été ü", "b_c\\d", "%", "1.0E10", " 2.0", "beta 1 alpha", "5 0.0"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_equals_the_scan_on_every_term(spark, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    df = spark.createDataFrame(ROWS * 3, "s STRING, n INT, `x y` DOUBLE").repartition(4)
    result = pages.store(df)
    text_index.build(result)
    for term in TERMS:
        assert rows(text_index.search(result, term)) == rows(explore.result_search(df, term)), term


def test_reads_only_files_with_candidates(spark):
    df = spark.range(0, 800, numPartitions=8).select(F.concat(F.lit("row number "), F.col("id").cast("string")).alias("text"))
    result = pages.store(df)
    text_index.build(result)
    found = text_index.search(result, "number 777")
    assert [r.text for r in found.collect()] == ["row number 777"]
    held = text_index.candidates(result, "number 777").collect()
    assert [len(r.rows) for r in held] == [1]


def test_empty_result(spark):
    result = pages.store(spark.createDataFrame([], "s STRING"))
    text_index.build(result)
    assert text_index.search(result, "abc").count() == 0 and text_index.search(result, "a").count() == 0
