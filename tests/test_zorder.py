"""The interleaved layout of the event log."""

import glob
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlens.sources import zorder
from model_rows import EVENTS_DDL


def events(spark, hot=False):
    base = datetime(2024, 1, 1)
    rows = [(i * 7919 % 1000 if not (hot and i % 3 == 0) else 500, "app_open", base + timedelta(hours=i * 104729 % 8760)) for i in range(20_000)]
    return spark.createDataFrame(rows + [(None, "app_open", base), (5, "signup", None), (None, None, None)], EVENTS_DDL)


@pytest.fixture(scope="module", params=[False, True])
def laid(spark, request, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('zorder')}/events"
    log = events(spark, request.param)
    zorder.write(log, path, num_files=64)
    return log, path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_round_trip(laid, spark):
    log, path = laid
    assert rows(zorder.read(spark, path)) == rows(log)


def test_lookups_open_few_files(laid, spark):
    log, path = laid
    n = len(glob.glob(f"{path[7:]}/*.parquet"))
    assert n >= 48
    for user in (3, 250, 777):
        found = zorder.read(spark, path, user_id=user)
        assert rows(found) == rows(log.where(F.col("user_id") == user)) and len(found.inputFiles()) < n / 4
    for first in (date(2024, 2, 1), date(2024, 9, 10)):
        last = first + timedelta(days=7)
        found = zorder.read(spark, path, first=first, last=last)
        assert rows(found) == rows(log.where((F.col("event_date") >= F.lit(first)) & (F.col("event_date") < F.lit(last))))
        assert len(found.inputFiles()) < n / 4
        both = zorder.read(spark, path, user_id=500, first=first, last=last)
        assert rows(both) == rows(found.where("user_id = 500")) and len(both.inputFiles()) <= max(3, n / 16)


def test_a_user_with_a_third_of_the_events_is_spread(laid, spark):
    log, path = laid
    sizes = [r.n for r in spark.read.parquet(f"{path}/{zorder.INDEX}").collect()]
    assert max(sizes) < 5 * sum(sizes) / len(sizes)


def test_absent_values(laid, spark):
    _, path = laid
    assert zorder.read(spark, path, user_id=10**6).count() == 0 and zorder.files_of(spark, path, user_id=10**6) == []
    assert zorder.read(spark, path, first=date(2030, 1, 1)).count() == 0


def scanned(df):
    """Rows that the scan of a plan hands on after it skipped row groups."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_bloom_filter_skips_absent_users(spark, tmp_path):
    """Even numbers only: an odd one lies within every file's range, and only the filter can tell."""
    path = f"file://{tmp_path}/even"
    base = datetime(2024, 1, 1)
    log = spark.createDataFrame([(2 * (i * 7919 % 5000), "app_open", base + timedelta(hours=i % 8760)) for i in range(20_000)], EVENTS_DDL)
    zorder.write(log, path, num_files=8)
    plain = spark.read.parquet(path)
    assert scanned(plain.where("user_id = 4001")) == 0
    assert 0 < scanned(plain.where("user_id = 4000")) < 20_000


def test_empty_log(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    zorder.write(spark.createDataFrame([], EVENTS_DDL), path, num_files=4)
    assert zorder.read(spark, path).count() == 0 and zorder.read(spark, path, user_id=1).count() == 0


def test_ranks_follow_the_cut_points(spark):
    cuts = [10, 20, 20, 20, 30]
    got = spark.createDataFrame([(v,) for v in (None, 5, 10, 19, 20, 29, 30, 99)], "v INT").select(zorder.rank_of(F.col("v"), cuts).alias("r"))
    assert [r.r for r in got.collect()] == [0, 0, 1, 1, 4, 4, 5, 5]
    z = spark.range(1).select(zorder.interleaved(F.lit(0b101), F.lit(0b011), 3).alias("z")).first().z
    assert z == 0b100111
