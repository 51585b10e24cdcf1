"""Data-quality checks on clean and dirty rows."""

from model_rows import SF001, ts
from cohortlens.operators import quality as Q
from cohortlens.plans import registry
from cohortlens.session import stored


def dirty(make, event_1_date="2025-01-05"):
    users = make("users", [
        (1, ts("2025-01-10"), "referral", None, None, None),
        (1, ts("2025-01-10"), "referral", None, None, None),   # duplicate key
        (2, None, "referral", None, None, None),               # NULL signup date
        (None, ts("2025-01-01"), "referral", None, None, None),  # NULL key
    ])
    events = make("events", [
        (1, "app_open", ts(event_1_date)),
        (2, "app_open", ts("2025-01-01")),
        (None, "app_open", ts("2025-01-01")),  # NULL key: not an orphan
        (9, "app_open", ts("2025-01-01")),     # orphan
    ])
    subs = make("subscriptions", [(9, None, "monthly", 9.99), (1, None, "monthly", None)])
    return users, events, subs


def one(df):
    return df.collect()[0][0]


def test_checks_on_dirty_rows(make):
    users, events, subs = dirty(make)
    assert one(Q.user_pk_duplicates(users)) == 1           # NULL key not detected here
    assert one(Q.orphan_rows(events, users)) == 1
    assert one(Q.orphan_rows(subs, users)) == 1
    assert one(Q.events_before_signup(users, events)) == 2  # duplicate user doubles it
    # users: 2 rows (NULL date, NULL key); events: 1 (NULL key); subscriptions: 1 (NULL price)
    assert one(Q.mandatory_nulls(users, events, subs)) == 4


def test_equal_dates_are_allowed(make):
    users, events, _ = dirty(make, event_1_date="2025-01-10")
    assert one(Q.events_before_signup(users, events)) == 0


def test_report_messages(make):
    users, events, subs = dirty(make)
    rows = Q.quality_report(users, events, subs).orderBy("check_order").collect()
    assert [r.passed for r in rows] == [False] * 5
    assert rows[0].details == "1 duplicate user_ids detected!"
    assert rows[1].details == "1 orphan event records found!"
    assert rows[2].details == "1 orphan subscription records found!"
    assert rows[3].details == "2 events precede signup date!"
    assert rows[4].details == "4 null values in mandatory fields!"
    assert one(Q.all_passed(Q.quality_report(users, events, subs))) is False


def test_all_checks_pass_on_test_tables(spark):
    rows = registry.QUERIES["dq_report"](spark, SF001).orderBy("check_order").collect()
    assert [r.check_name for r in rows] == [
        "User Primary Key Uniqueness", "Events Foreign Key Integrity", "Subscriptions Foreign Key Integrity",
        "Event Temporal Consistency", "Mandatory Fields Non-Null Constraint"]
    assert all(r.passed for r in rows), [r.details for r in rows]
    assert rows[0].details == "0 duplicate user_ids found."
    assert one(registry.QUERIES["dq_all_passed"](spark, SF001)) is True


def test_null_signup_reported_at_sf01(spark):
    # one customer has no order at sf0.1, so its signup date is NULL
    assert one(registry.QUERIES["dq_non_null"](spark, "/root/testdata/sf0.1")) == 1


def test_table_counts(spark):
    counts = {r.table_name: r.row_count for r in registry.QUERIES["table_counts"](spark, SF001).collect()}
    assert set(counts) == {"users", "events", "subscriptions"}
    assert counts["users"] > 0 and counts["events"] > 0


def test_many_copies_of_one_user(make):
    users = make("users", [(1, ts("2025-01-10"), "referral", None, None, None)] * 50
                 + [(2, ts("2025-01-10"), "referral", None, None, None)])
    events = make("events", [(1, "app_open", ts("2025-01-01"))] * 3 + [(1, "app_open", ts("2025-01-02"))]
                  + [(7, "app_open", ts("2025-01-02"))])
    assert one(Q.user_pk_duplicates(users)) == 49
    assert one(Q.events_before_signup(users, events)) == 4 * 50
    assert one(Q.orphan_rows(events, users)) == 1


def test_early_pairs_broadcast_nothing(spark):
    """Pairs of an event and a later signup, on one day and on others, from stored rows; no side goes through the driver."""
    signups = [(u, ts(f"2025-01-{d:02d} {h}:00:00"), c) for u in range(40) for d, h, c in ((10, "12", 1), (10, "08", 2), (12, "00", 1))]
    events = [(u, ts(f"2025-01-{d:02d} {h}:00:00"), 1 + u % 3) for u in range(20, 60) for d in (9, 10, 12, 13) for h in ("00", "08", "11")]
    dates = stored(spark.createDataFrame(signups + [(None, ts("2025-01-20"), 1)], "user_id long, signup_date timestamp_ntz, copies long"), "dates")
    own = stored(spark.createDataFrame(events + [(None, ts("2025-01-01"), 1)], "user_id long, event_date timestamp_ntz, n long"), "own")
    found = Q.early_pairs(dates, own)
    want = sum(c * n for u, s, c in signups for v, e, n in events if u == v and e < s)
    assert one(found) == want > 0
    plan = found._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Generate" not in plan
