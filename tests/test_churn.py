"""Churn rule, tiers, rollup, top-k."""

from model_rows import SF01, ts
from cohortlens.operators import churn as C
from cohortlens.plans import registry

U = [(i, ts("2025-01-01"), "referral", None, None, None) for i in range(1, 6)]
E = [
    (1, "signup", ts("2025-01-01")),                                   # 95 - 1 = 94
    (3, "signup", ts("2025-01-01")), (3, "onboarding_complete", ts("2025-01-01")),
    (3, "first_edit", ts("2025-01-02")), (3, "trial_started", ts("2025-01-03")),  # 95-85-4 = 6
    (4, "subscribed", ts("2025-01-09")),                               # 0
] + [(5, "app_open", ts("2025-01-02"))] * 12                           # 95 - min(12, 10) = 85


def scores(make):
    return C.churn_scores(C.churn_features(make("users", U), make("events", E)))


def test_rule(make):
    s = {r.user_id: r.risk_score for r in scores(make).collect()}
    assert s == {1: 94.0, 2: 95.0, 3: 6.0, 4: 0.0, 5: 85.0}


def test_tiers_rollup_topk(make):
    sc = scores(make)
    tiers = {r.user_id: r.risk_tier for r in C.churn_tiers(sc).collect()}
    assert tiers == {1: "high", 2: "high", 3: "low", 4: "low", 5: "high"}
    r = C.churn_rollup(sc).collect()[0]
    assert (r.high_risk_count, r.medium_risk_count, r.low_risk_count) == (3, 0, 2)
    assert r.avg_churn_risk_pct == round((94 + 95 + 6 + 0 + 85) / 5, 1)
    top = C.at_risk_users(sc, k=3).collect()
    assert [t.user_id for t in top] == [2, 1, 5]  # subscribed user 4 never listed


def test_empty_rollup_is_zeros(make):
    r = C.churn_rollup(C.churn_scores(C.churn_features(make("users", []), make("events", [])))).collect()[0]
    assert tuple(r) == (0, 0, 0, 0.0)


def test_on_test_tables(spark):
    r = registry.QUERIES["churn_rollup"](spark, SF01).collect()[0]
    assert (r.high_risk_count, r.medium_risk_count, r.low_risk_count, r.avg_churn_risk_pct) == (35, 235, 1230, 18.8)
    top = registry.QUERIES["at_risk_users"](spark, SF01).collect()
    assert len(top) == 10
    keys = [(-t.risk_score, t.user_id) for t in top]
    assert keys == sorted(keys)
    assert 0.0 <= r.avg_churn_risk_pct <= 100.0
