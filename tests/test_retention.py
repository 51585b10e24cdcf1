"""Cohort retention, month buckets, curve, heatmap."""

import random
from datetime import datetime, timedelta

import pytest

from model_rows import SF01, ts
from cohortlens.operators import retention as R
from cohortlens.plans import registry


def U(uid, signup):
    return (uid, ts(signup), "referral", "iOS", "US", "control_self_serve")


def test_month_bucket_is_30_4_days_not_calendar(make):
    users = make("users", [U(1, "2025-04-10"), U(2, "2025-05-20")])
    events = make("events", [
        (1, "app_open", ts("2025-05-03")),  # 30 days between month starts -> 0
        (1, "app_open", ts("2025-06-03")),  # 61 -> 2
        (1, "app_open", ts("2025-07-03")),  # 91 -> 2
        (1, "app_open", ts("2025-08-03")),  # 122 -> 4, outside 0..3
        (2, "app_open", ts("2025-04-25")),  # month before signup: -30/30.4 -> 0
        (2, "signup", ts("2025-05-20")),    # not an activity event
    ])
    got = sorted((r.cohort_month, r.month_number, r.retained_users) for r in R.cohort_retention(users, events).collect())
    assert got == [("2025-04", 0, 1), ("2025-04", 2, 1), ("2025-05", 0, 1)]


def test_retention_pct_and_absent_cells(make):
    users = make("users", [U(1, "2025-01-05"), U(2, "2025-01-06"), U(3, "2025-01-07")])
    events = make("events", [(1, "app_open", ts("2025-01-10")), (1, "app_open", ts("2025-01-11")),
                             (2, "app_open", ts("2025-03-01"))])
    rows = R.cohort_retention(users, events).collect()
    assert [(r.month_number, r.cohort_users, r.retained_users, r.retention_pct) for r in rows] == [
        (0, 3, 1, 33.3), (1, 3, 1, 33.3)]
    heat = R.cohort_heatmap(R.cohort_retention(users, events)).collect()[0]
    assert (heat.m0, heat.m1, heat.m2, heat.m3) == (33.3, 33.3, None, None)
    assert (heat.m0_class, heat.m2_class) == ("low", None)


def test_curve_is_mean_of_rounded_pcts_over_present_cohorts(spark):
    # The published cohort table (cohort, size, month, retained, pct).
    cells = [
        ("2025-01", 129, 0, 42, 32.6), ("2025-01", 129, 1, 64, 49.6), ("2025-01", 129, 2, 45, 34.9), ("2025-01", 129, 3, 41, 31.8),
        ("2025-02", 203, 0, 127, 62.6), ("2025-02", 203, 1, 98, 48.3), ("2025-02", 203, 2, 74, 36.5), ("2025-02", 203, 3, 68, 33.5),
        ("2025-03", 268, 0, 89, 33.2), ("2025-03", 268, 1, 128, 47.8), ("2025-03", 268, 2, 97, 36.2), ("2025-03", 268, 3, 80, 29.9),
        ("2025-04", 358, 0, 208, 58.1), ("2025-04", 358, 2, 163, 45.5),
        ("2025-05", 426, 0, 180, 42.3), ("2025-05", 426, 1, 211, 49.5), ("2025-05", 426, 2, 171, 40.1), ("2025-05", 426, 3, 127, 29.8),
        ("2025-06", 473, 0, 266, 56.2), ("2025-06", 473, 2, 194, 41.0), ("2025-06", 473, 3, 160, 33.8),
        ("2025-07", 522, 0, 230, 44.1), ("2025-07", 522, 1, 275, 52.7), ("2025-07", 522, 2, 215, 41.2), ("2025-07", 522, 3, 179, 34.3),
        ("2025-08", 624, 0, 235, 37.7), ("2025-08", 624, 1, 288, 46.2), ("2025-08", 624, 2, 236, 37.8), ("2025-08", 624, 3, 196, 31.4),
        ("2025-09", 667, 0, 362, 54.3), ("2025-09", 667, 2, 273, 40.9),
        ("2025-10", 719, 0, 279, 38.8), ("2025-10", 719, 1, 325, 45.2), ("2025-10", 719, 2, 272, 37.8),
        ("2025-11", 785, 0, 402, 51.2),
        ("2025-12", 826, 0, 373, 45.2),
    ]
    df = spark.createDataFrame(cells, "cohort_month STRING, cohort_users BIGINT, month_number INT, retained_users BIGINT, retention_pct DOUBLE")
    curve = {r.month_number: (r.avg_retention_pct, r.n_cohorts) for r in R.retention_curve(df).collect()}
    assert curve[0] == (pytest.approx(46.358, abs=1e-3), 12)
    assert curve[1] == (pytest.approx(48.471, abs=1e-3), 7)
    assert curve[2] == (pytest.approx(39.190, abs=1e-3), 10)
    assert curve[3] == (pytest.approx(32.071, abs=1e-3), 7)
    # and the published percentages follow from the published counts
    from cohortlens.functions.columns import pct
    for r in df.select("retention_pct", pct("retained_users", "cohort_users", 1).alias("p")).collect():
        assert r.retention_pct == r.p


def test_retention_on_test_tables(spark):
    rows = registry.QUERIES["cohort_retention"](spark, SF01).collect()
    assert len(rows) == 108
    first = [r for r in rows if r.cohort_month == "1995-01"]
    assert [r.retained_users for r in first] == [107, 29, 11, 18]
    sizes = {r.cohort_month: r.cohort_users for r in registry.QUERIES["cohort_size"](spark, SF01).collect()}
    assert sum(sizes.values()) == 1500
    for r in rows:
        assert r.retained_users <= r.cohort_users == sizes[r.cohort_month]


def plain(users, events, months, days):
    """Cells by walking over all rows."""
    out = {}
    for uid, signup, *_ in users:
        if uid is None or signup is None:
            continue
        cohort = (signup.year, signup.month)
        out.setdefault(cohort, (set(), {}))[0].add(uid)
        start = signup.replace(day=1, hour=0, minute=0, second=0)
        for who, name, date in events:
            if who == uid and name == "app_open" and date is not None:
                n = int((date.replace(day=1, hour=0, minute=0, second=0) - start).days / days)
                if n in months:
                    out[cohort][1].setdefault(n, set()).add(uid)
    return sorted((f"{y:04d}-{m:02d}", len(who), n, len(active)) for (y, m), (who, cells) in out.items() for n, active in cells.items())


@pytest.mark.parametrize("months,days", [((0, 1, 2, 3), 30.4), ((0, 1, 11, 12, 13, 36, 400), 30.4), ((0, 2, 5), 7.0), ((0, 1, 2), 61.0), ((-2, -1, 0), 30.4)])
def test_bits_over_many_years(make, months, days):
    """Signups and activity over 60 years: several longs a user, cohorts at their borders, leap years."""
    rng = random.Random(3)

    def moment():
        return datetime(rng.randrange(1975, 2035), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24))

    users, events = [], []
    for uid in range(60):
        start = moment()
        users += [(uid, start, "referral", "iOS", "US", "control_self_serve")] * rng.choice([1, 1, 3])
        if uid % 7 == 0:  # a key with two signups
            users.append((uid, moment(), "referral", "iOS", "US", "control_self_serve"))
        for _ in range(rng.randrange(12)):
            events.append((uid, rng.choice(["app_open", "app_open", "signup"]), start + timedelta(days=rng.randrange(-120, 900) if rng.random() < 0.9 else 12_170)))
    users += [(None, moment(), "referral", "iOS", "US", None), (99, None, "referral", "iOS", "US", None)]
    events += [(None, "app_open", moment()), (5, "app_open", None), (99, "app_open", moment())]
    events += [(3, "app_open", users[3][1] + timedelta(days=i % 40)) for i in range(800)]  # most of the events
    found = R.cohort_retention(make("users", users), make("events", events), months=months, days=days)
    assert sorted((r.cohort_month, r.cohort_users, r.month_number, r.retained_users) for r in found.collect()) == plain(users, events, months, days)


def test_empty_relations(make):
    one = [U(1, "2025-01-05")]
    assert R.cohort_retention(make("users", []), make("events", [(1, "app_open", ts("2025-01-10"))])).collect() == []
    assert R.cohort_retention(make("users", one), make("events", [])).collect() == []


def test_four_exchanges(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        m = registry.load_model(spark, SF01)
        stored = [spark.createDataFrame(df.collect(), df.schema) for df in (m.users, m.events)]  # without the derivation's own
        plan = R.cohort_retention(*stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange ") <= 4 and "Expand" not in plan
