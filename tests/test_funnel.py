"""Funnel, flags, tiers, long form."""

from pyspark.sql import functions as F

from model_rows import SF01, ts
from cohortlens.operators import flags, funnel
from cohortlens.plans import registry

U = [
    (1, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve"),
    (2, ts("2025-01-02"), "referral", "iOS", "US", "treatment_guided_edit"),
    (3, ts("2025-01-03"), "referral", "iOS", "US", "control_self_serve"),  # no events at all
    (4, ts("2025-01-04"), "influencer", "iOS", "US", "control_self_serve"),
]
E = [
    (1, "signup", ts("2025-01-01")), (1, "onboarding_complete", ts("2025-01-01 05:00:00")),
    (1, "first_edit", ts("2025-01-02")), (1, "first_edit", ts("2025-01-03")),
    (2, "signup", ts("2025-01-02")), (2, "subscribed", ts("2025-01-10")),  # a stage without its predecessors
    (4, "signup", ts("2025-01-04")),
]


def test_funnel_counts_are_independent_distinct_counts(make):
    f = {r.channel: r for r in funnel.funnel_by_channel(make("users", U), make("events", E)).collect()}
    ref = f["referral"]
    assert (ref.signups, ref.onboarded, ref.edited, ref.trialed, ref.subscribed) == (3, 1, 1, 0, 1)
    assert ref.pct_onboarded == 33.3
    assert ref.pct_onboarded_to_edit == 100.0
    assert ref.pct_edit_to_trial == 0.0
    assert ref.pct_trial_to_paid is None  # zero trialed: NULL, not an error
    assert ref.overall_conversion_pct == 33.33
    inf = f["influencer"]
    assert (inf.signups, inf.onboarded, inf.pct_onboarded_to_edit) == (1, 0, None)


def test_funnel_order_and_tiers(make):
    fn = funnel.funnel_by_channel(make("users", U), make("events", E))
    assert [r.channel for r in fn.collect()] == ["referral", "influencer"]
    tiers = {r.channel: r.conversion_tier for r in funnel.conversion_tiers(fn).collect()}
    assert tiers == {"referral": "High Conv", "influencer": "Standard"}


def test_duplicate_user_rows_count_once(make):
    users = make("users", U + [U[0]])
    f = {r.channel: r for r in funnel.funnel_by_channel(users, make("events", E)).collect()}
    assert f["referral"].signups == 3 and f["referral"].onboarded == 1


def test_flags_keep_users_without_events(make):
    rows = {r.user_id: r for r in flags.user_activity_flags(make("users", U), make("events", E)).collect()}
    assert rows[3].total_event_count == 0 and rows[3].unique_events == 0 and rows[3].has_onboarded == 0
    assert rows[1].total_event_count == 4 and rows[1].unique_events == 3 and rows[1].has_edited == 1


def test_funnel_long_and_labels(make):
    fn = funnel.funnel_by_channel(make("users", U), make("events", E))
    long = funnel.funnel_long(fn).where(F.col("channel") == "referral").orderBy("stage_order").collect()
    assert [r.stage for r in long] == ["signups", "onboarded", "edited", "trialed", "subscribed"]
    assert [r.users for r in long] == [3, 1, 1, 0, 1]
    labels = {r.channel: r.channel_label for r in funnel.channel_labels(fn).collect()}
    assert labels == {"referral": "Referral", "influencer": "Influencer"}


def test_published_rates_from_published_counts(spark):
    # The published funnel counts and rates.
    rows = [
        ("referral", 956, 704, 661, 299, 154, 73.6, 93.9, 45.2, 51.5, 16.11),
        ("organic_search", 1790, 1182, 961, 394, 187, 66.0, 81.3, 41.0, 47.5, 10.45),
        ("app_store_featured", 594, 361, 268, 103, 41, 60.8, 74.2, 38.4, 39.8, 6.9),
        ("paid_social", 1673, 725, 414, 128, 50, 43.3, 57.1, 30.9, 39.1, 2.99),
        ("influencer", 987, 398, 209, 58, 24, 40.3, 52.5, 27.8, 41.4, 2.43),
    ]
    counts = spark.createDataFrame(
        [r[:6] for r in rows], "channel STRING, signups BIGINT, onboarded BIGINT, edited BIGINT, trialed BIGINT, subscribed BIGINT"
    )
    got = {r.channel: r for r in funnel.funnel_table(counts).collect()}
    for r in rows:
        g = got[r[0]]
        assert (g.pct_onboarded, g.pct_onboarded_to_edit, g.pct_edit_to_trial, g.pct_trial_to_paid,
                g.overall_conversion_pct) == r[6:]


def test_funnel_on_test_tables(spark):
    f = {r.channel: r for r in registry.QUERIES["funnel_by_channel"](spark, SF01).collect()}
    a = f["AUTOMOBILE"]
    assert (a.signups, a.onboarded, a.edited, a.trialed, a.subscribed, a.overall_conversion_pct) == (
        298, 253, 143, 143, 151, 50.67)
    b = f["BUILDING"]
    assert (b.signups, b.onboarded, b.edited, b.trialed, b.subscribed, b.overall_conversion_pct) == (
        302, 258, 144, 149, 127, 42.05)
    one = registry.QUERIES["funnel_for_channel"](spark, SF01).collect()
    assert len(one) == 1 and one[0].asDict() == b.asDict()
    assert sum(r.signups for r in f.values()) == 1500
    for r in f.values():  # stages never exceed signups
        assert max(r.onboarded, r.edited, r.trialed, r.subscribed) <= r.signups


def test_funnel_equals_saved_sql(spark):
    from cohortlens.plans.catalog import run_saved
    registry._with_views(spark, SF01)
    a = sorted(tuple(r) for r in registry.QUERIES["funnel_by_channel"](spark, SF01).collect())
    b = sorted(tuple(r) for r in run_saved(spark, "funnel").collect())
    assert a == b
