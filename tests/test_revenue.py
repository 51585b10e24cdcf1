"""Revenue segmentation."""


from model_rows import SF01, ts
from cohortlens.operators import revenue as V
from cohortlens.plans import registry

U = [
    (1, ts("2025-01-01"), "referral", "iOS", "US", "c"),
    (2, ts("2025-01-01"), "referral", "iOS", "US", "c"),
    (3, ts("2025-01-01"), "paid_social", "iOS", "US", "c"),  # channel without subscriptions
]
S = [
    (1, ts("2025-01-10"), "annual", 79.99),
    (1, ts("2025-02-10"), "monthly", 9.99),  # a second subscription of the same user
    (2, ts("2025-01-10"), "monthly", 9.99),
]


def test_revenue_semantics(make):
    rows = V.revenue_by_channel(make("users", U), make("subscriptions", S)).collect()
    assert [r.channel for r in rows] == ["referral", "paid_social"]  # NULL revenue sorts last
    ref, ps = rows
    assert (ref.total_signups, ref.paying_users, ref.total_revenue_usd) == (2, 2, 99.97)
    assert ref.revenue_per_signup_usd == round(99.97 / 2, 3)
    assert ref.pct_revenue_from_annual == round(79.99 / 99.97 * 100, 1)
    assert (ps.total_signups, ps.paying_users, ps.total_revenue_usd, ps.pct_revenue_from_annual) == (1, 0, None, None)


def test_share_and_labels(make):
    rev = V.revenue_by_channel(make("users", U), make("subscriptions", S))
    share = {r.channel: r.revenue_share_pct for r in V.revenue_share(rev).collect()}
    assert share == {"referral": 100.0, "paid_social": None}
    lab = V.revenue_labelled(rev).collect()
    assert [(r.channel_name, r.channel_label) for r in lab] == [("Referral", "Referral"), ("Paid Social", "Paid Social")]


def test_revenue_on_test_tables(spark):
    rows = {r.channel: r for r in registry.QUERIES["revenue_by_channel"](spark, SF01).collect()}
    a = rows["AUTOMOBILE"]
    assert (a.total_signups, a.paying_users, a.total_revenue_usd, a.revenue_per_signup_usd, a.pct_revenue_from_annual) == (
        298, 151, 7007.82, 23.516, 78.8)


def test_revenue_decimal_sums_at_sf01(spark):
    rows = {r.channel: r for r in registry.QUERIES["revenue_by_channel"](spark, "/root/testdata/sf0.1").collect()}
    a = rows["AUTOMOBILE"]
    assert (a.total_signups, a.paying_users, a.total_revenue_usd, a.revenue_per_signup_usd, a.pct_revenue_from_annual) == (
        3045, 1474, 69409.36, 22.795, 80.3)


def test_copied_users_rows_count_once_as_signups_but_repeat_revenue(make):
    users = make("users", U + [U[0]] * 3)  # user 1 stored four times
    ref = V.revenue_by_channel(users, make("subscriptions", S)).collect()[0]
    assert (ref.total_signups, ref.paying_users) == (2, 2)
    # the joined SUM sees user 1's subscriptions once per stored users row
    assert ref.total_revenue_usd == round(4 * (79.99 + 9.99) + 9.99, 2)
