"""Hot keys: one user owns a third of the events, one key is copied over a third
of the users rows. Results must equal brute-force SQL over the same rows."""

import math
from datetime import datetime, timedelta

import duckdb
import pytest

from cohortlens.operators import churn, flags, funnel, quality, retention, revenue, summary
from cohortlens.plans.oracle import analysis_sql

CHANNELS = ["referral", "organic_search", "paid_social"]
NAMES = ["signup", "onboarding_complete", "first_edit", "trial_started", "subscribed", "app_open"]


def fixture_rows():
    base = datetime(2025, 1, 1)
    users = [(u, base + timedelta(days=u % 90), CHANNELS[u % 3], "iOS", "US",
              "control_self_serve" if u % 2 == 0 else "treatment_guided_edit") for u in range(1, 201)]
    users += [(None, base, CHANNELS[0], "iOS", "US", "control_self_serve"), (None, base, None, "iOS", "US", None)]
    users += [users[0]] * 100                                  # user 1 copied: a third of the rows
    events = []
    for i in range(3000):
        uid = 1 if i % 3 == 0 else 2 + (i * 7) % 199           # user 1 owns a third of the events
        events.append((uid, NAMES[(i * 5) % 6], base + timedelta(days=(i * 13) % 200)))
    events.append((999, "app_open", base))                     # orphan
    events.append((None, "app_open", base))
    subs = [(uid, base + timedelta(days=uid % 40), "annual" if uid % 3 == 0 else "monthly",
             79.99 if uid % 3 == 0 else 9.99) for uid in (1, 1, 5, 9, 12, 33, 150)]
    return users, events, subs


@pytest.fixture(scope="module")
def data(spark):
    users, events, subs = fixture_rows()
    from model_rows import EVENTS_DDL, SUBS_DDL, USERS_DDL
    u = spark.createDataFrame(users, USERS_DDL)
    e = spark.createDataFrame(events, EVENTS_DDL)
    s = spark.createDataFrame(subs, SUBS_DDL)
    con = duckdb.connect()
    con.execute("CREATE TABLE m_users(user_id BIGINT, signup_date TIMESTAMP, channel VARCHAR, platform VARCHAR, "
                "country VARCHAR, experiment_group VARCHAR)")
    con.execute("CREATE TABLE m_events(user_id BIGINT, event_name VARCHAR, event_date TIMESTAMP)")
    con.execute("CREATE TABLE m_subscriptions(user_id BIGINT, subscribed_date TIMESTAMP, plan VARCHAR, price_usd DOUBLE)")
    con.executemany("INSERT INTO m_users VALUES (?, ?, ?, ?, ?, ?)", users)
    con.executemany("INSERT INTO m_events VALUES (?, ?, ?)", events)
    con.executemany("INSERT INTO m_subscriptions VALUES (?, ?, ?, ?)", subs)
    return u, e, s, con


def same(df, con, final_sql):
    cols = df.columns
    mine = sorted((tuple(r) for r in df.collect()), key=repr)
    res = con.execute(analysis_sql(final_sql))
    ocols = [d[0] for d in res.description]
    idx = [ocols.index(c) for c in cols]
    theirs = sorted((tuple(r[i] for i in idx) for r in res.fetchall()), key=repr)
    norm = lambda rows: [tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows]
    assert norm(mine) == norm(theirs)
    return mine


def test_funnel(data):
    u, e, _, con = data
    rows = same(funnel.funnel_by_channel(u, e), con, "SELECT * FROM funnel")
    assert sum(r[1] for r in rows) == 200 and None in [r[0] for r in rows]


def test_retention(data):
    u, e, _, con = data
    same(retention.cohort_retention(u, e), con, "SELECT * FROM retention")


def test_revenue(data):
    u, _, s, con = data
    same(revenue.revenue_by_channel(u, s), con, "SELECT * FROM revenue")


def test_quality(data):
    u, e, s, con = data
    rows = same(quality.quality_report(u, e, s), con, "SELECT * FROM dq_report")
    assert "100 duplicate user_ids detected!" in [r[3] for r in rows]


def test_churn(data):
    u, e, _, con = data
    rows = same(churn.churn_features(u, e), con, "SELECT * FROM features")
    assert len(rows) == 201  # those without a key are one
    scores = churn.churn_scores(churn.churn_features(u, e))
    same(scores, con, "SELECT * FROM scores")
    same(churn.churn_rollup(scores), con, "SELECT * FROM rollup")
    one = flags.user_activity_flags(u, e).where("user_id = 1").collect()
    assert len(one) == 1 and one[0].total_event_count == 101 * 1000


def test_summary(data):
    u, e, s, con = data
    a = summary.Analyses(summary.Model(u, e, s))
    for df, sql in ((a.funnel, "funnel"), (a.retention, "retention"), (a.revenue, "revenue"), (a.readout, "readout"),
                    (a.report, "dq_report"), (a.rollup, "rollup")):
        same(df, con, f"SELECT * FROM {sql}")
    assert a.at_risk.collect() == churn.at_risk_users(churn.churn_scores(churn.churn_features(u, e))).collect()


def test_early_events_of_a_hot_user_are_spread(spark, data):
    u, e, _, con = data
    late = u.selectExpr("user_id", "signup_date + INTERVAL 100 DAY AS signup_date", "channel")
    found = quality.events_before_signup(late, e)
    n = con.execute("SELECT count(*) FROM m_events e JOIN m_users u USING (user_id) WHERE e.event_date < u.signup_date + INTERVAL 100 DAY")
    assert found.first().invalid_date_count == n.fetchall()[0][0] > 0
    assert "salt" in found._jdf.queryExecution().optimizedPlan().toString()
