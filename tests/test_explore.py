"""Ad-hoc SQL, explain, lookups, journeys, search, assignment."""

import pytest
from pyspark.sql import functions as F

from model_rows import SF001, ts
from cohortlens.functions.columns import cumulative_cuts, hash_bucket, weighted_choice
from cohortlens.operators import explore as X
from cohortlens.plans import registry


def test_normalise_user_id(spark):
    df = spark.createDataFrame([(" user_0042 ",), ("000",), ("USER_7",), ("",), ("abc",), ("\tuser_09\n",)], "t STRING")
    got = [r[0] for r in df.select(X.normalise_user_id(F.col("t"))).collect()]
    assert got == [42, 1, 7, 1, None, 9]


def test_adhoc_sql_is_query_only_with_bound_args(spark):
    registry._with_views(spark, SF001)
    df = X.adhoc_sql(spark, "SELECT COUNT(*) AS total_users FROM m_users WHERE user_id >= :lo;", {"lo": 0})
    assert df.columns == ["total_users"] and df.first().total_users > 0
    with_comment = X.adhoc_sql(spark, "SELECT 1 AS x -- trailing comment")
    assert with_comment.first().x == 1
    spark.sql("CREATE OR REPLACE TEMP VIEW keep_me AS SELECT 1 AS x")
    for bad in ("DROP VIEW keep_me", "SELECT 1) ; DROP VIEW keep_me; (SELECT 1", "SHOW TABLES"):
        with pytest.raises(Exception):
            X.adhoc_sql(spark, bad)
    assert spark.sql("SELECT * FROM keep_me").first().x == 1


def test_adhoc_result_has_every_row(spark, tmp_path):
    registry._with_views(spark, SF001)
    text = "SELECT e.user_id, e.event_name, e.event_date FROM m_events e"
    n = spark.table("m_events").count()
    assert n > 1000
    res = X.adhoc_result(spark, text)
    assert res["status"] == "success" and len(res["rows"].collect()) == n
    assert res["columns"] == ["user_id", "event_name", "event_date"]
    assert res["count"] == n
    written = X.adhoc_result(spark, text, path=str(tmp_path / "all"))
    assert written["count"] == n == spark.read.parquet(written["path"]).count()
    assert X.adhoc_result(spark, "SELECT nope FROM m_users")["status"] == "error"


@pytest.mark.parametrize("text", [
    "SELECT 1 AS x; -- note", "SELECT 1 AS x; /* a */ -- b\n", "SELECT 1 AS x;;", "SELECT 1 AS x -- note;",
    "SELECT 1 AS x; -- a\n-- b", "SELECT 1 AS x, ';-- no comment' AS s",
])
def test_semicolons_and_comments_at_the_end(spark, text):
    assert X.adhoc_sql(spark, text).first().x == 1


def test_lookups_by_text(make):
    users = make("users", [(42, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve")])
    events = make("events", [(42, "signup", ts("2025-01-01"))])
    subs = make("subscriptions", [(42, ts("2025-02-01"), "annual", 79.99)])
    assert X.user_profile(users, " user_0042 ").first().user_id == 42
    assert X.user_timeline(events, "USER_42").first().event_label == "SIGNUP"
    assert X.user_subscription(users, subs, "042").first().plan == "annual"
    assert X.user_profile(users, "nobody").count() == 0


def test_journeys_events(make):
    users = make("users", [(1, ts("2025-01-01"), "referral", "iOS", "US", "a"), (2, ts("2025-01-01"), "x", "iOS", "US", "a")] * 2)
    events = make("events", [(1, "signup", ts("2025-01-01")), (1, "first_edit", ts("2025-01-03")), (9, "signup", ts("2025-01-01"))])
    subs = make("subscriptions", [(1, ts("2025-02-01"), "annual", 79.99)])
    rows = X.user_journeys_events(users, events, subs).collect()
    assert [(r.user_id, r.event_label, r.plan_label) for r in rows] == [
        (1, "SIGNUP", "annual ($79.99)"), (1, "FIRST EDIT", "annual ($79.99)"), (2, None, "Free Tier")]


def test_user_lookups(make):
    users = make("users", [(8, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve"),
                           (9, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve")])
    subs = make("subscriptions", [(8, ts("2025-03-01"), "monthly", 9.99), (8, ts("2025-02-01"), "annual", 79.99)])
    assert X.user_profile(users, 8).count() == 1 and X.user_profile(users, 99).count() == 0
    s8 = X.user_subscription(users, subs, 8).collect()[0]
    assert (s8.plan, s8.plan_label) == ("annual", "annual ($79.99)")
    s9 = X.user_subscription(users, subs, 9).collect()[0]
    assert (s9.plan, s9.plan_label) == (None, "Free Tier")
    events = make("events", [(8, "first_edit", ts("2025-01-02")), (8, "signup", ts("2025-01-01")),
                             (9, "signup", ts("2025-01-01"))])
    tl = X.user_timeline(events, 8).collect()
    assert [(r.event_name, r.event_label) for r in tl] == [("signup", "SIGNUP"), ("first_edit", "FIRST EDIT")]


def test_journeys(spark):
    ev = spark.createDataFrame(
        [(1, "view", ts("2024-01-02"), 3), (1, "signup", ts("2024-01-01"), 1), (1, "click", ts("2024-01-02"), 2)],
        "user_id BIGINT, event_name STRING, event_date TIMESTAMP_NTZ, event_id BIGINT")
    r = X.user_journeys(ev).collect()[0]
    assert (r.n_events, r.n_event_types, r.first_event, r.last_event) == (3, 3, "signup", "view")


def test_result_search(spark):
    df = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "channel STRING, n INT")
    assert [r.channel for r in X.result_search(df, "Build").collect()] == ["BUILDING"]


def test_weighted_assignment(spark):
    assert cumulative_cuts([("a", 0.3), ("b", 0.28), ("c", 0.15), ("d", 0.17), ("e", 0.1)]) == [
        ("a", 3000), ("b", 5800), ("c", 7300), ("d", 9000), ("e", 10000)]
    df = spark.range(20000).select(
        hash_bucket(F.col("id"), "exp1").alias("b"),
        weighted_choice(F.col("id"), "exp1", [("c", 0.5), ("t", 0.5)]).alias("arm"))
    r = df.agg(F.min("b"), F.max("b"), F.avg((F.col("arm") == "c").cast("double"))).first()
    assert r[0] >= 0 and r[1] < 10000
    assert r[2] == pytest.approx(0.5, abs=0.02)


def test_explain_reports_errors_as_text_and_accepts_semicolon(spark):
    registry._with_views(spark, SF001)
    ok = X.explain_plan(spark, "SELECT channel FROM m_users;").collect()[0].plan
    assert "Physical Plan" in ok
    bad = X.explain_plan(spark, "SELECT no_such_column FROM m_users").collect()[0].plan
    assert "no_such_column" in bad
