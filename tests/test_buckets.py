"""The model in buckets by user."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import churn, experiment, funnel, revenue
from cohortlens.session import new_path
from cohortlens.sources import buckets
from cohortlens.sources.model import Model, load_model
from model_rows import EVENTS_DDL, SF01, SUBS_DDL, USERS_DDL
from test_skew import fixture_rows

ANALYSES = {
    "funnel": lambda m: funnel.funnel_by_channel(m.users, m.events),
    "readout": lambda m: experiment.ab_readout(m.users, m.events),
    "revenue": lambda m: revenue.revenue_by_channel(m.users, m.subscriptions),
    "churn": lambda m: churn.churn_scores(churn.churn_features(m.users, m.events)),
}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stored(spark):
    model = load_model(spark, SF01)
    base = new_path(spark, "buckets")
    buckets.write_model(model, base, buckets=4)
    return model, base


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanges_by_user(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "user_id" in line.split("hashpartitioning(")[1].split(",")[0]]


@pytest.mark.parametrize("name", ANALYSES)
def test_no_exchange_by_user(spark, stored, no_broadcast, name):
    model, base = stored
    build = ANALYSES[name]
    found = build(buckets.read_model(spark, base))
    assert exchanges_by_user(found) == [] and exchanges_by_user(build(model)) != []
    assert rows(found) == rows(build(model))


def test_other_sessions_find_the_buckets(spark, stored, no_broadcast):
    model, base = stored
    for relation in ("users", "events", "subscriptions"):
        spark.sql(f"DROP TABLE {buckets._name(f'{base}/{relation}')}")  # an external table: its files stay
    again = buckets.read_model(spark, base)
    assert exchanges_by_user(ANALYSES["funnel"](again)) == []
    assert [rows(df) for df in again] == [rows(df) for df in model]


def test_a_user_with_a_third_of_the_events(spark, no_broadcast):
    users, events, subs = fixture_rows()
    model = Model(*(spark.createDataFrame(r, d) for r, d in zip((users, events * 5, subs), (USERS_DDL, EVENTS_DDL, SUBS_DDL))))
    base = new_path(spark, "hot")
    buckets.write_model(model, base, buckets=16)
    again = buckets.read_model(spark, base)
    for build in ANALYSES.values():
        assert rows(build(again)) == rows(build(model))


def test_a_skewed_relation_is_read_as_files(spark, stored, monkeypatch):
    model, base = stored
    assert not buckets.is_skewed(buckets.bucket_bytes(spark, f"{base}/events"), 4)
    assert buckets.is_skewed({0: 100, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}, 8) and not buckets.is_skewed({}, 4)
    monkeypatch.setattr(buckets, "is_skewed", lambda sizes, n: True)
    plain = buckets.read_model(spark, base)
    assert exchanges_by_user(ANALYSES["funnel"](plain)) != [] and rows(plain.events) == rows(model.events)


def test_number_of_buckets_follows_the_size(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_BYTES", 2000)
    base = new_path(spark, "sized")
    model = load_model(spark, SF01)
    buckets.write_model(model, base)
    assert len(buckets.bucket_bytes(spark, f"{base}/events")) > 4
    assert [rows(df) for df in buckets.read_model(spark, base)] == [rows(df) for df in model]


def test_number_of_buckets_follows_the_rows(spark):
    """Rows that take hardly any stored bytes do not all come to one task."""
    users, events, subs = (spark.createDataFrame([], d) for d in (USERS_DDL, EVENTS_DDL, SUBS_DDL))
    many = spark.range(2_200_000).selectExpr("id % 1000 user_id", "'app_open' event_name", "timestamp_ntz'2024-01-01' event_date")
    base = new_path(spark, "many-rows")
    buckets.write_model(Model(users, many, subs), base)
    assert buckets._about(spark, f"{base}/events")["buckets"] == 3
    found = buckets.read_model(spark, base).events.groupBy("user_id").count().agg(F.min("count"), F.count("user_id")).first()
    assert tuple(found) == (2200, 1000)
