"""Driver contract, summary rows, and the Spark-vs-SQL oracle check on the smallest tables."""

import json
import math

import duckdb

from model_rows import SF001
import __spark_entry__ as entry_mod
from cohortlens.plans import registry
from cohortlens.sources.tables import TABLE_NAMES, table_path


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and df.columns[0] == "channel"


def test_every_sql_key_is_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and set(registry.QUERIES) <= set(q)
    assert set(registry.QUERIES) - set(o) == {"dashboard_payload"}


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def test_queries_match_sql_oracle(spark):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    q, o = registry.queries(), registry.oracle_sql()
    bad = []
    for key, sql in o.items():
        df = q[key](spark, SF001)
        cols = df.columns
        mine = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
        res = con.execute(sql)
        ocols = [d[0] for d in res.description]
        if sorted(cols) != sorted(ocols):
            bad.append((key, "columns", cols, ocols))
            continue
        idx = [ocols.index(c) for c in cols]
        theirs = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
        if mine != theirs:
            bad.append((key, "values"))
    assert not bad, bad


def test_kpi_and_payload(spark):
    k = entry_mod.queries()["kpi_summary"](spark, SF001).collect()[0]
    funnel = entry_mod.queries()["funnel_by_channel"](spark, SF001).collect()
    assert k.total_signups == sum(r.signups for r in funnel) == 150
    assert k.total_paying_users == sum(r.subscribed for r in funnel)
    assert k.dq_all_passed is True
    doc = json.loads(entry_mod.queries()["dashboard_payload"](spark, SF001).collect()[0].payload)
    assert set(doc) >= {"summary", "funnel", "cohort", "ab_test", "revenue", "queries", "data_quality", "churn"}
    assert [r["channel"] for r in doc["funnel"]] == [r.channel for r in funnel]
    assert len(doc["data_quality"]) == 5 and len(doc["churn"]["at_risk_users"]) == 10
    assert set(doc["queries"]) == {"funnel", "cohort", "ab_test", "revenue"}
    assert doc["summary"]["total_signups"] == 150


def test_kpi_with_copied_users_rows(spark, make):
    from cohortlens.operators import churn, funnel, revenue, summary
    from cohortlens.sources.model import Model
    from model_rows import ts
    u = [(1, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve"),
         (2, ts("2025-01-01"), "referral", "iOS", "US", "treatment_guided_edit")]
    e = [(1, "signup", ts("2025-01-01")), (2, "onboarding_complete", ts("2025-01-02"))]
    s = [(1, ts("2025-01-05"), "annual", 79.99)]
    m = Model(make("users", u + [u[0]] * 4), make("events", e), make("subscriptions", s))
    k = summary.kpi_summary(m).collect()[0]
    f = funnel.funnel_by_channel(m.users, m.events).collect()
    r = revenue.revenue_by_channel(m.users, m.subscriptions).collect()
    roll = churn.churn_rollup(churn.churn_scores(churn.churn_features(m.users, m.events))).collect()[0]
    assert k.total_signups == sum(x.signups for x in f) == 2
    assert k.total_revenue == r[0].total_revenue_usd == round(5 * 79.99, 2)
    assert k.avg_churn_risk_pct == roll.avg_churn_risk_pct
    assert k.high_churn_users_count == roll.high_risk_count == 1  # user 1 (95 - 5 events) is one user; user 2 scores 69
    top = churn.at_risk_users(churn.churn_scores(churn.churn_features(m.users, m.events))).collect()
    doc = json.loads(summary.dashboard_payload(m, {}).collect()[0].payload)
    assert [r.user_id for r in top] == [r["user_id"] for r in doc["churn"]["at_risk_users"]] == [1, 2]


def test_payload_sections_equal_the_sql_oracle(spark):
    """The rows-only payload, section by section, against the oracle SQL of each analysis."""
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF001, t)}')")
    o = entry_mod.oracle_sql()
    doc = json.loads(entry_mod.queries()["dashboard_payload"](spark, SF001).collect()[0].payload)

    def oracle_rows(key):
        res = con.execute(o[key])
        cols = [d[0] for d in res.description]
        return [dict(zip(cols, r)) for r in res.fetchall()]

    def same(section, key, cols):
        mine = sorted(tuple(_norm(r[c]) for c in cols) for r in section)
        theirs = sorted(tuple(_norm(r[c]) for c in cols) for r in oracle_rows(key))
        assert mine == theirs, key

    same(doc["funnel"], "funnel_by_channel", ["channel", "signups", "subscribed", "overall_conversion_pct"])
    same(doc["cohort"], "cohort_retention", ["cohort_month", "month_number", "retained_users", "retention_pct"])
    same(doc["revenue"], "revenue_by_channel", ["channel", "total_revenue_usd", "revenue_per_signup_usd"])
    same(doc["ab_test"]["groups"], "ab_readout", ["experiment_group", "users_in_group", "activated_users"])
    same([doc["ab_test"]["result"]], "ab_ztest", ["z_stat", "p_value", "ci_lower_pp", "ci_upper_pp", "cohens_h"])
    same(doc["data_quality"], "dq_report", ["check_name", "passed", "details"])
    churn = doc["churn"]
    same([churn], "churn_rollup", ["high_risk_count", "medium_risk_count", "low_risk_count", "avg_churn_risk_pct"])
    kpi = oracle_rows("kpi_summary")[0]
    for c in ("total_signups", "total_revenue", "overall_conversion_pct", "ab_p_value", "dq_all_passed"):
        assert _norm(doc["summary"][c]) == _norm(kpi[c]), c
    # payload lists keep the analyses' order
    assert [r["overall_conversion_pct"] for r in doc["funnel"]] == sorted(
        (r["overall_conversion_pct"] for r in doc["funnel"]), reverse=True)


def test_payload_keeps_null_fields_and_puts_them_last(make):
    from cohortlens.operators import summary
    from cohortlens.sources.model import Model
    from model_rows import ts
    u = [(1, ts("2025-01-01"), "influencer", "iOS", "US", "control_self_serve"),
         (2, ts("2025-01-01"), "referral", "iOS", "US", "control_self_serve")]
    m = Model(make("users", u), make("events", [(2, "signup", ts("2025-01-01"))]),
              make("subscriptions", [(2, ts("2025-01-05"), "annual", 79.99)]))
    doc = json.loads(summary.dashboard_payload(m, {}).collect()[0].payload)
    assert [r["channel"] for r in doc["revenue"]] == ["referral", "influencer"]
    last = doc["revenue"][1]
    assert last["total_revenue_usd"] is None and last["revenue_per_signup_usd"] is None and last["pct_revenue_from_annual"] is None
    assert doc["funnel"][0]["pct_trial_to_paid"] is None
    assert doc["ab_test"]["result"]["z_stat"] is None and "p_value" in doc["ab_test"]["result"]


def test_summary_of_an_empty_model(make):
    from cohortlens.operators import summary
    from cohortlens.sources.model import Model
    m = Model(make("users", []), make("events", []), make("subscriptions", []))
    k = summary.kpi_summary(m).collect()[0]
    assert k.overall_conversion_pct == 0.0 and k.dq_all_passed is True and k.avg_churn_risk_pct == 0.0


def test_labels_and_tiers_differ(spark):
    labels = registry.QUERIES["channel_labels"](spark, SF001).collect()
    assert any(r.channel != r.channel_label for r in labels)
    from model_rows import SF01
    tiers = registry.QUERIES["conversion_tiers_custom"](spark, SF01).collect()
    assert {r.conversion_tier for r in tiers} == {"High Conv", "Converted", "Standard"}
