"""Independent SQL (DuckDB dialect) for every registered query.

Each analysis is stated over sets: who is a member of a segment (distinct rows), who did something
(EXISTS / IN a set of users), which rows have no partner (NOT EXISTS). The Spark
plans get the same numbers by other ways (flags per user, joins of aggregates, sums of cells). The normal tail is a power
series here and a rational approximation there. Dialect notes: DuckDB rounds on
CAST(double AS INT), so the month bucket truncates first; literals such as
``100.0`` are DECIMAL there, so doubles are written as CAST(... AS DOUBLE).
"""

from __future__ import annotations

from .. import constants as K
from ..operators.experiment import z_critical
from ..operators.flags import ACTIVITY_FLAGS

D = "CAST(100 AS DOUBLE)"

REAL_USERS = "SELECT * FROM r_users"
# All subscriptions as the users relation: repeated keys, orphans, events before the date.
REPEATED_USERS = (
    "SELECT user_id, subscribed_date AS signup_date, plan AS channel, NULL AS platform, NULL AS country, "
    "NULL AS experiment_group FROM m_subscriptions"
)
# The five segments under the names of the five labelled channels.
NAMED_USERS = "SELECT * REPLACE (CASE channel {} ELSE channel END AS channel) FROM r_users"

MODEL_CTES = {
    "r_users": """
SELECT CAST(c.c_custkey AS BIGINT) AS user_id,
       f.signup_date,
       c.c_mktsegment AS channel,
       CASE WHEN c.c_custkey % 20 < 11 THEN 'iOS' ELSE 'Android' END AS platform,
       n.n_name AS country,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'control_self_serve' ELSE 'treatment_guided_edit' END AS experiment_group
FROM customer c
LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS signup_date FROM orders GROUP BY o_custkey) f
       ON c.c_custkey = f.o_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "m_events": """
SELECT user_id, 'signup' AS event_name, signup_date AS event_date FROM r_users WHERE signup_date IS NOT NULL
UNION ALL
SELECT CAST(o_custkey AS BIGINT) AS user_id,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'onboarding_complete'
            WHEN o_orderstatus <> 'F' OR o_orderpriority = '5-LOW' THEN 'app_open'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'first_edit'
            WHEN o_orderpriority = '2-HIGH' THEN 'trial_started'
            WHEN o_orderpriority = '1-URGENT' THEN 'subscribed' END AS event_name,
       o_orderdate AS event_date
FROM orders""",
    "m_subscriptions": """
SELECT CAST(o_custkey AS BIGINT) AS user_id,
       o_orderdate AS subscribed_date,
       CASE WHEN o_orderkey % 20 < 7 THEN 'annual' ELSE 'monthly' END AS plan,
       CASE WHEN o_orderkey % 20 < 7 THEN CAST(79.99 AS DOUBLE) ELSE CAST(9.99 AS DOUBLE) END AS price_usd
FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'""",
    "m_users": REAL_USERS,
}


def _did(event: str) -> str:
    return f"user_id IN (SELECT user_id FROM m_events WHERE event_name = '{event}')"


def _stage(column: str) -> str:
    return f"count(*) FILTER (WHERE {_did(dict(K.FUNNEL_STAGES)[column])}) AS {column}"


def _per_hundred(part: str, whole: str, digits: int, name: str) -> str:
    return f"round({D} * {part} / nullif({whole}, 0), {digits}) AS {name}"


FUNNEL_COUNTS = f"""
SELECT channel, count(user_id) AS signups, {", ".join(_stage(c) for c, _ in K.FUNNEL_STAGES)}
FROM (SELECT DISTINCT channel, user_id FROM m_users) person
GROUP BY ALL"""

FUNNEL_STEPS = ("signups", "onboarded", "edited", "trialed", "subscribed")
FUNNEL_RATES = ("pct_onboarded", "pct_onboarded_to_edit", "pct_edit_to_trial", "pct_trial_to_paid")
FUNNEL_SELECT = (
    "SELECT channel, signups, "
    + ", ".join(
        f"{now}, {_per_hundred(now, before, 1, rate)}" for before, now, rate in zip(FUNNEL_STEPS, FUNNEL_STEPS[1:], FUNNEL_RATES)
    )
    + f", {_per_hundred('subscribed', 'signups', 2, 'overall_conversion_pct')} FROM funnel_counts"
)

MONTHS_BETWEEN = "CAST(trunc(date_diff('day', joined, seen) / 30.4) AS INTEGER)"

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ZC = repr(z_critical(K.ALPHA))


def _tail(x: str) -> str:
    """P(Z > x) for x >= 0: one half less the density times the sum of x^(2k+1) / (1 * 3 * ... * (2k+1))."""
    term = f"exp((2 * k + 1) * ln({x}) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi()))"
    area = f"exp(-{x} * {x} / 2.0) / sqrt(2.0 * pi()) * list_sum([{term} FOR k IN range(0, 150)])"
    return f"(CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 9 THEN 0.0 ELSE greatest(0.0, 0.5 - {area}) END)"


def two_sided_p_sql(z: str) -> str:
    return f"(CASE WHEN {z} IS NOT NULL THEN 2.0 * {_tail(f'abs({z})')} END)"


def cdf_sql(y: str) -> str:
    return f"(CASE WHEN {y} >= 0 THEN 1.0 - {_tail(f'abs({y})')} WHEN {y} < 0 THEN {_tail(f'abs({y})')} END)"


def _readout(segments: str = "") -> str:
    keys = ", ".join(filter(None, (segments, "experiment_group")))
    return f"""
SELECT *, {_per_hundred("activated_users", "users_in_group", 2, "activation_rate_pct")}
FROM (SELECT {keys}, count(user_id) AS users_in_group, count(*) FILTER (WHERE {_did(K.ACTIVATION_EVENT)}) AS activated_users
      FROM (SELECT DISTINCT {keys}, user_id FROM m_users) GROUP BY ALL)"""


def _aligned(source: str, segments: str = "") -> str:
    seg = f"{segments}, " if segments else ""
    group = f"GROUP BY {segments}" if segments else ""
    return f"""
SELECT {seg}
       CAST(MAX(CASE WHEN experiment_group = 'control_self_serve' THEN users_in_group END) AS DOUBLE) AS n1,
       CAST(MAX(CASE WHEN experiment_group = 'treatment_guided_edit' THEN users_in_group END) AS DOUBLE) AS n2,
       CAST(MAX(CASE WHEN experiment_group = 'control_self_serve' THEN activated_users END) AS DOUBLE) AS x1,
       CAST(MAX(CASE WHEN experiment_group = 'treatment_guided_edit' THEN activated_users END) AS DOUBLE) AS x2
FROM {source}
{group}"""


def _rates(source: str, segments: str = "") -> str:
    seg = f"{segments}, " if segments else ""
    return f"""
SELECT {seg}n1, n2, x1, x2,
       x1 / NULLIF(n1, 0.0) AS p1,
       x2 / NULLIF(n2, 0.0) AS p2,
       (x1 + x2) / NULLIF(n1 + n2, 0.0) AS p_pool
FROM {source}"""


def _stats(source: str, segments: str = "") -> str:
    seg = f"{segments}, " if segments else ""
    z = "((p2 - p1) / NULLIF(sqrt(p_pool * (1.0 - p_pool) * (1.0 / NULLIF(n1, 0) + 1.0 / NULLIF(n2, 0))), 0.0))"
    se_u = "sqrt((p1 * (1.0 - p1) / NULLIF(n1, 0)) + (p2 * (1.0 - p2) / NULLIF(n2, 0)))"
    return f"""
SELECT {seg}n1, n2, x1, x2, p1, p2,
       (p2 - p1) * 100.0 AS abs_lift_pp,
       CASE WHEN p1 > 0 THEN (p2 - p1) / p1 * 100.0 ELSE 0.0 END AS rel_lift_pct,
       {z} AS z_stat,
       ((p2 - p1) - {ZC} * {se_u}) * 100.0 AS ci_lower_pp,
       ((p2 - p1) + {ZC} * {se_u}) * 100.0 AS ci_upper_pp,
       abs(2.0 * asin(sqrt(p2)) - 2.0 * asin(sqrt(p1))) AS cohens_h,
       {two_sided_p_sql(z)} AS p_value
FROM {source}"""


def _published(source: str, segments: str = "") -> str:
    seg = f"{segments}, " if segments else ""
    return f"""
SELECT {seg}CAST(n1 AS BIGINT) AS n_control, CAST(n2 AS BIGINT) AS n_treatment,
       CAST(x1 AS BIGINT) AS x_control, CAST(x2 AS BIGINT) AS x_treatment,
       ROUND(p1 * 100.0, 2) AS p_control, ROUND(p2 * 100.0, 2) AS p_treatment,
       ROUND(abs_lift_pp, 2) AS abs_lift_pp, ROUND(rel_lift_pct, 2) AS rel_lift_pct,
       ROUND(ci_lower_pp, 2) AS ci_lower_pp, ROUND(ci_upper_pp, 2) AS ci_upper_pp,
       ROUND(z_stat, 3) AS z_stat, ROUND(p_value, 5) AS p_value, ROUND(cohens_h, 4) AS cohens_h,
       p_value < {K.ALPHA!r} AS is_significant
FROM {source}"""


def _risk() -> str:
    dbl = "CAST({} AS DOUBLE)".format
    raw = (
        f"{dbl(95)} - has_onboarded * {dbl(25)} - has_edited * {dbl(30)} - has_trialed * {dbl(30)}"
        f" - LEAST(total_event_count, 10) * {dbl(1)}"
    )
    return f"GREATEST({dbl(0)}, LEAST({dbl(100)}, CASE WHEN is_subscribed = 1 THEN {dbl(0)} ELSE {raw} END))"


def _dq_row(order: int, key: str, count_sql: str) -> str:
    name, ok, fail = K.DQ_CHECKS[key]
    fmt = fail.replace("{}", "%d")
    return (
        f"SELECT {order} AS check_order, '{name}' AS check_name, n = 0 AS passed, "
        f"CASE WHEN n = 0 THEN '{ok}' ELSE printf('{fmt}', n) END AS details FROM ({count_sql}) t(n)"
    )


# Analysis CTEs (after the model CTEs), in dependency order.
CTES = dict(MODEL_CTES)
CTES.update({
    "funnel_counts": FUNNEL_COUNTS,
    "funnel": FUNNEL_SELECT,
    "member": "SELECT DISTINCT user_id, CAST(date_trunc('month', signup_date) AS DATE) AS joined FROM m_users",
    "cohort_size": "SELECT strftime(joined, '%Y-%m') AS cohort_month, count(user_id) AS cohort_users FROM member GROUP BY joined",
    "visit": """
SELECT DISTINCT user_id, CAST(date_trunc('month', event_date) AS DATE) AS seen FROM m_events WHERE event_name = 'app_open'""",
    "stay": f"""
SELECT DISTINCT strftime(joined, '%Y-%m') AS cohort_month, user_id, {MONTHS_BETWEEN} AS month_number
FROM member NATURAL JOIN visit""",
    "retention": f"""
SELECT cohort_month, cohort_users, month_number, retained_users, {_per_hundred("retained_users", "cohort_users", 1, "retention_pct")}
FROM cohort_size NATURAL JOIN (
    SELECT cohort_month, month_number, count(*) AS retained_users FROM stay WHERE month_number IN (0, 1, 2, 3) GROUP BY ALL)""",
    "readout": _readout(),
    "aligned": _aligned("readout"),
    "rates": _rates("aligned"),
    "ab_stats": _stats("rates"),
    "ab": _published("ab_stats"),
    "readout_ch": _readout("channel"),
    "aligned_ch": _aligned("readout_ch", "channel"),
    "rates_ch": _rates("aligned_ch", "channel"),
    "ab_stats_ch": _stats("rates_ch", "channel"),
    "spend": """
SELECT user_id, sum(CAST(price_usd AS DECIMAL(28,8))) AS paid,
       sum(CAST(price_usd AS DECIMAL(28,8))) FILTER (WHERE plan = 'annual') AS paid_annual
FROM m_subscriptions GROUP BY user_id""",
    "revenue": f"""
SELECT channel, total_signups, paying_users, round(total, 2) AS total_revenue_usd,
       round(total / nullif(total_signups, 0), 3) AS revenue_per_signup_usd,
       round(annual / nullif(total, 0) * {D}, 1) AS pct_revenue_from_annual
FROM (SELECT channel, count(DISTINCT user_id) AS total_signups,
             count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM spend)) AS paying_users,
             CAST(sum(paid) AS DOUBLE) AS total, CAST(coalesce(sum(paid_annual), 0) AS DOUBLE) AS annual
      FROM m_users LEFT JOIN spend USING (user_id) GROUP BY channel)""",
    "dq_pk": """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_count
FROM (SELECT count(*) AS n FROM m_users WHERE user_id IS NOT NULL GROUP BY user_id)""",
    "dq_efk": """
SELECT count(*) AS orphan_count FROM m_events e
WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_users u WHERE u.user_id = e.user_id)""",
    "dq_sfk": """
SELECT count(*) AS orphan_count FROM m_subscriptions s
WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_users u WHERE u.user_id = s.user_id)""",
    "dq_temporal": """
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS invalid_date_count
FROM (SELECT (SELECT count(*) FROM m_events e WHERE e.user_id = u.user_id AND e.event_date < u.signup_date) AS n FROM m_users u)""",
    "dq_nulls": """
SELECT count(*) AS null_count FROM (
    SELECT 1 FROM m_users WHERE NOT (user_id IS NOT NULL AND signup_date IS NOT NULL AND channel IS NOT NULL)
    UNION ALL SELECT 1 FROM m_events WHERE NOT (user_id IS NOT NULL AND event_name IS NOT NULL AND event_date IS NOT NULL)
    UNION ALL SELECT 1 FROM m_subscriptions WHERE NOT (user_id IS NOT NULL AND price_usd IS NOT NULL))""",
    "dq_report": " UNION ALL ".join([
        _dq_row(1, "user_pk", "SELECT duplicate_count FROM dq_pk"),
        _dq_row(2, "events_fk", "SELECT orphan_count FROM dq_efk"),
        _dq_row(3, "subscriptions_fk", "SELECT orphan_count FROM dq_sfk"),
        _dq_row(4, "event_temporal", "SELECT invalid_date_count FROM dq_temporal"),
        _dq_row(5, "non_null", "SELECT null_count FROM dq_nulls"),
    ]),
    "activity": """
SELECT user_id, count(DISTINCT event_name) AS kinds, count(event_name) AS n FROM m_events GROUP BY user_id""",
    "features": f"""
SELECT user_id, least_channel AS channel, first_signup AS signup_date,
       coalesce(kinds, 0) AS unique_events, coalesce(n, 0) * copies AS total_event_count,
       {", ".join(f"CASE WHEN user_id IS NOT NULL AND {_did(e)} THEN 1 ELSE 0 END AS {c}" for c, e in ACTIVITY_FLAGS)}
FROM (SELECT user_id, min(channel) AS least_channel, min(signup_date) AS first_signup, count(*) AS copies
      FROM m_users GROUP BY user_id) LEFT JOIN activity USING (user_id)""",
    "scores": f"""
SELECT user_id, channel, has_onboarded, has_edited, has_trialed, is_subscribed, total_event_count,
       {_risk()} AS risk_score
FROM features""",
    "rollup": """
SELECT CAST(count_if(risk_score >= 70) AS BIGINT) AS high_risk_count,
       CAST(count_if(risk_score >= 40 AND risk_score < 70) AS BIGINT) AS medium_risk_count,
       CAST(count_if(risk_score < 40) AS BIGINT) AS low_risk_count,
       COALESCE(ROUND(AVG(risk_score), 1), CAST(0 AS DOUBLE)) AS avg_churn_risk_pct
FROM scores""",
})


LATER_USERS = f"SELECT * REPLACE (signup_date + INTERVAL 30 DAY AS signup_date) FROM ({REAL_USERS})"


def _with(final_sql: str, model: bool = True, users: str = REAL_USERS) -> str:
    """``final_sql`` after all CTEs; ``model=False`` leaves out the derivation
    of m_users / m_events / m_subscriptions so that they resolve to tables;
    ``users`` is the users relation of the analyses."""
    body = CTES | {"m_users": users} if model else {k: v for k, v in CTES.items() if k not in MODEL_CTES}
    ctes = ",\n".join(f"{name} AS ({text}\n)" for name, text in body.items())
    return f"WITH {ctes}\n{final_sql}"


def analysis_sql(final_sql: str) -> str:
    """Brute-force SQL over existing m_users / m_events / m_subscriptions tables."""
    return _with(final_sql, model=False)


# First bucket (of 10,000) above each value of the weighted choices.
ASSIGN_CUTS = {
    "arm": (("control_self_serve", 5000), ("treatment_guided_edit", 10000)),
    "platform": (("iOS", 5500), ("Android", 10000)),
    "channel": (
        ("organic_search", 3000), ("paid_social", 5800), ("referral", 7300), ("influencer", 9000), ("app_store_featured", 10000),
    ),
    "country": (("US", 3500), ("IN", 6000), ("UK", 7200), ("BR", 8200), ("DE", 9200), ("CA", 10000)),
    "plan": (("monthly", 6500), ("annual", 10000)),
}


def _assign(salt: str, cuts: str) -> str:
    bucket = f"(CAST(('0x' || substr(md5('{salt}' || ':' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10000)"
    whens = " ".join(f"WHEN {bucket} < {b} THEN '{v}'" for v, b in ASSIGN_CUTS[cuts])
    return f"CASE {whens} END"


def _initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({x}), ' '), "
        f"lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
    )


REPLACE_UNDERSCORES = "replace(channel, '_', ' ')"


def _channel_label(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.CHANNEL_LABELS.items())
    return f"(CASE {x} {whens} ELSE {x} END)"


def _summary_text() -> str:
    L = K.AB_TEXT_LINES
    sign = "CASE WHEN {} >= 0 THEN '+' ELSE '' END".format
    verdict = f"CASE WHEN p_value < {K.ALPHA!r} THEN '{K.AB_SIGNIFICANT}' ELSE '{K.AB_NOT_SIGNIFICANT}' END"
    level = int(round((1.0 - K.ALPHA) * 100))
    lines = [
        f"printf('{L[0]}', p1 * 100, CAST(n1 AS BIGINT))",
        f"printf('{L[1]}', p2 * 100, CAST(n2 AS BIGINT))",
        f"printf('{L[2]}', {sign('abs_lift_pp')}, abs_lift_pp)",
        f"printf('{L[3]}', {sign('rel_lift_pct')}, rel_lift_pct)",
        f"printf('{L[4]}', {level}, ci_lower_pp, ci_upper_pp)",
        f"printf('{L[5]}', z_stat)",
        f"printf('{L[6]}', p_value)",
        f"printf('{L[7].replace(chr(39), chr(39) * 2)}', cohens_h)",
        f"printf('{L[8]}', {verdict}, {level})",
    ]
    return f"SELECT concat_ws(chr(10), {', '.join(lines)}) || chr(10) AS summary FROM ab_stats"


def _whatif() -> str:
    n = float(K.WHATIF_N_PER_ARM)
    z = f"((p2 - p1) / NULLIF(sqrt(((p1 + p2) / 2.0) * (1.0 - ((p1 + p2) / 2.0)) * (2.0 / {n!r})), 0.0))"
    p = two_sided_p_sql(z)
    return f"""
SELECT channel, ROUND(p1 * 100.0, 2) AS p1_pct, ROUND(p2 * 100.0, 2) AS p2_pct,
       CAST({K.WHATIF_N_PER_ARM} AS BIGINT) AS n_per_arm,
       ROUND({z}, 3) AS z_stat, ROUND({p}, 5) AS p_value, {p} < {K.ALPHA!r} AS is_significant
FROM rates_ch"""


def _power() -> str:
    arg = f"(abs(cohens_h) * sqrt(1.0 / (1.0 / n1 + 1.0 / n2)) - {ZC})"
    return f"""
SELECT CAST(n1 AS BIGINT) AS n_control, CAST(n2 AS BIGINT) AS n_treatment,
       ROUND(cohens_h, 4) AS cohens_h, CAST({K.ALPHA!r} AS DOUBLE) AS alpha,
       ROUND({cdf_sql(arg)}, 4) AS power
FROM ab_stats"""


def _heatmap() -> str:
    cells = ", ".join(f"MAX(CASE WHEN month_number = {m} THEN retention_pct END) AS m{m}" for m in K.RETENTION_MONTHS)
    cls = ", ".join(
        f"CASE WHEN m{m} >= {K.HEAT_HIGH!r} THEN 'high' WHEN m{m} >= {K.HEAT_MID!r} THEN 'mid' "
        f"WHEN m{m} IS NOT NULL THEN 'low' END AS m{m}_class"
        for m in K.RETENTION_MONTHS
    )
    ms = ", ".join(f"m{m}" for m in K.RETENTION_MONTHS)
    return f"""
SELECT cohort_month, cohort_users, {ms}, {cls}
FROM (SELECT cohort_month, cohort_users, {cells} FROM retention GROUP BY cohort_month, cohort_users)"""


def _funnel_long() -> str:
    stages = ["signups"] + [c for c, _ in K.FUNNEL_STAGES]
    parts = " UNION ALL ".join(
        f"SELECT channel, signups, '{s}' AS stage, {i} AS stage_order, {s} AS users FROM funnel"
        for i, s in enumerate(stages, start=1)
    )
    return f"""
SELECT channel, stage, CAST(stage_order AS INTEGER) AS stage_order, users,
       ROUND({D} * users / NULLIF(signups, 0), 1) AS pct_of_signups
FROM ({parts})"""


def _kpi() -> str:
    return """
SELECT CAST((SELECT SUM(signups) FROM funnel) AS BIGINT) AS total_signups,
       (SELECT ROUND(SUM(total_revenue_usd), 2) FROM revenue) AS total_revenue,
       CAST((SELECT SUM(subscribed) FROM funnel) AS BIGINT) AS total_paying_users,
       CASE WHEN (SELECT SUM(signups) FROM funnel) > 0
            THEN ROUND(CAST((SELECT SUM(subscribed) FROM funnel) AS DOUBLE) / (SELECT SUM(signups) FROM funnel) * 100.0, 2)
            ELSE 0.0 END AS overall_conversion_pct,
       (SELECT abs_lift_pp FROM ab) AS ab_lift_pp,
       (SELECT p_value FROM ab) AS ab_p_value,
       (SELECT is_significant FROM ab) AS ab_is_significant,
       (SELECT bool_and(passed) FROM dq_report) AS dq_all_passed,
       (SELECT avg_churn_risk_pct FROM rollup) AS avg_churn_risk_pct,
       (SELECT high_risk_count FROM rollup) AS high_churn_users_count"""


def _result_search(term: str) -> str:
    cols = [
        "channel", "signups", "onboarded", "pct_onboarded", "edited", "pct_onboarded_to_edit", "trialed",
        "pct_edit_to_trial", "subscribed", "pct_trial_to_paid", "overall_conversion_pct",
    ]
    text = "lower(concat_ws(' ', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + "))"
    return f"SELECT * FROM funnel WHERE contains({text}, '{term.lower()}')"


def _texts(source: str, section: str, order: str, columns: dict[str, str]) -> str:
    """(section, position, key, value) rows: numbers with four decimals ('n'), other values as text ('t')."""
    def text(c, kind):
        return f"printf('%.4f', CAST({c} AS DOUBLE))" if kind == "n" else f"CAST({c} AS VARCHAR)"

    rows = " UNION ALL ".join(
        f"SELECT '{section}' AS section, CAST(position AS INTEGER) AS position, '{c}' AS key, "
        f"CASE WHEN {c} IS NOT NULL THEN {text(c, k)} ELSE {NULL_TEXT[k]} END AS value FROM numbered"
        for c, k in columns.items()
    )
    return f"SELECT * FROM (WITH numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM ({source})) {rows})"


# what Spark's format_string makes of a missing number, and of a missing text
NULL_TEXT = {"n": "'null'", "t": "NULL"}


def _payload_long() -> str:
    rate = {c: "n" for c in (*FUNNEL_STEPS, *FUNNEL_RATES, "overall_conversion_pct")}
    return " UNION ALL ".join([
        _texts("SELECT * FROM funnel", "funnel", "overall_conversion_pct DESC NULLS LAST, channel", {"channel": "t"} | rate),
        _texts("SELECT * FROM retention", "cohort", "cohort_month, month_number",
               {"cohort_month": "t", "cohort_users": "n", "month_number": "n", "retained_users": "n", "retention_pct": "n"}),
        _texts("SELECT * FROM revenue", "revenue", "revenue_per_signup_usd DESC NULLS LAST, channel",
               {"channel": "t", "total_signups": "n", "paying_users": "n", "total_revenue_usd": "n",
                "revenue_per_signup_usd": "n", "pct_revenue_from_annual": "n"}),
        _texts("SELECT * FROM readout", "groups", "experiment_group",
               {"experiment_group": "t", "users_in_group": "n", "activated_users": "n", "activation_rate_pct": "n"}),
        _texts("SELECT * FROM dq_report", "data_quality", "check_order", {"check_name": "t", "passed": "t", "details": "t"}),
        _texts(AT_RISK, "at_risk_users", "risk_score DESC, user_id",
               {"user_id": "n", "channel": "t", "risk_score": "n", "has_onboarded": "n", "has_edited": "n"}),
    ])


AT_RISK = (
    f"SELECT user_id, channel, risk_score, has_onboarded, has_edited FROM scores WHERE is_subscribed = 0 "
    f"ORDER BY risk_score DESC, user_id ASC LIMIT {K.AT_RISK_TOP_K}"
)


def _profile(uid: int) -> str:
    return _with(f"SELECT user_id, signup_date, channel, platform, country, experiment_group FROM m_users WHERE user_id = {uid}")


def _timeline(uid: int) -> str:
    return (
        "SELECT user_id, event_type AS event_name, ts AS event_date, event_id, "
        "upper(replace(event_type, '_', ' ')) AS event_label "
        f"FROM events WHERE user_id = {uid} ORDER BY ts, event_id"
    )


FIRST_PLAN = """
SELECT user_id, subscribed_date, plan, price_usd FROM m_subscriptions
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY subscribed_date, plan, price_usd) = 1"""
PLAN_LABEL = f"COALESCE(plan || ' ($' || CAST(price_usd AS VARCHAR) || ')', '{K.FREE_TIER_LABEL}') AS plan_label"


def _subscription(uid: int) -> str:
    return _with(
        f"SELECT user_id, subscribed_date, plan, price_usd, {PLAN_LABEL} "
        f"FROM (SELECT user_id FROM m_users WHERE user_id = {uid}) LEFT JOIN ({FIRST_PLAN}) USING (user_id)"
    )


def _journeys_events() -> str:
    return _with(f"""
SELECT user_id, signup_date, channel, platform, country, experiment_group, subscribed_date, plan, price_usd, {PLAN_LABEL},
       event_name, event_date, upper(replace(event_name, '_', ' ')) AS event_label
FROM m_users LEFT JOIN ({FIRST_PLAN}) USING (user_id) LEFT JOIN m_events USING (user_id)""")


def oracle_queries(params) -> dict[str, str]:
    """SQL per registry key; ``params`` supplies the fixed query parameters."""
    uid = params.user_id
    sub_uid = params.subscriber_id
    typed = int(params.typed_id.strip().lower().removeprefix("user_"))
    named = NAMED_USERS.format(" ".join(f"WHEN '{s}' THEN '{c}'" for s, c in zip(SEGMENTS, K.CHANNEL_LABELS)))
    return {
        "model_users": _with("SELECT * FROM m_users"),
        "model_events": _with("SELECT * FROM m_events"),
        "model_subscriptions": _with("SELECT * FROM m_subscriptions"),
        "table_counts": _with(
            "SELECT 'users' AS table_name, COUNT(*) AS row_count FROM m_users UNION ALL "
            "SELECT 'events', COUNT(*) FROM m_events UNION ALL "
            "SELECT 'subscriptions', COUNT(*) FROM m_subscriptions"
        ),
        "experiment_assignment": (
            "SELECT CAST(c_custkey AS BIGINT) AS user_id, "
            f"(CAST(('0x' || substr(md5('{params.salt}' || ':' || CAST(c_custkey AS VARCHAR)), 1, 8)) AS BIGINT) % 10000)"
            " AS assign_bucket, "
            f"{_assign(params.salt, 'arm')} AS experiment_group, "
            f"{_assign('platform', 'platform')} AS platform, "
            f"{_assign('channel', 'channel')} AS channel, "
            f"{_assign('country', 'country')} AS country, "
            f"{_assign('plan', 'plan')} AS plan "
            "FROM customer"
        ),
        "user_activity_flags": _with(
            "SELECT user_id, unique_events, total_event_count, has_onboarded, has_edited, has_trialed, is_subscribed "
            "FROM features"
        ),
        "funnel_by_channel": _with("SELECT * FROM funnel ORDER BY overall_conversion_pct DESC"),
        "funnel_for_channel": _with(f"SELECT * FROM funnel WHERE channel = '{params.channel}'"),
        "conversion_tiers": _with(
            "SELECT channel, overall_conversion_pct, CASE WHEN overall_conversion_pct > 10.0 THEN 'High Conv' "
            "WHEN overall_conversion_pct > 5.0 THEN 'Converted' ELSE 'Standard' END AS conversion_tier FROM funnel"
        ),
        "conversion_tiers_custom": _with(
            f"SELECT channel, overall_conversion_pct, CASE WHEN overall_conversion_pct > {params.tiers[0][0]} THEN '{params.tiers[0][1]}' "
            f"WHEN overall_conversion_pct > {params.tiers[1][0]} THEN '{params.tiers[1][1]}' ELSE '{K.CONVERSION_TIER_DEFAULT}' END "
            "AS conversion_tier FROM funnel"
        ),
        "funnel_long": _with(_funnel_long()),
        "event_counts": "SELECT event_type AS event_name, COUNT(*) AS event_count FROM events GROUP BY event_type",
        "cohort_size": _with("SELECT * FROM cohort_size"),
        "cohort_retention": _with("SELECT * FROM retention ORDER BY cohort_month, month_number"),
        "retention_curve": _with(
            "SELECT month_number, ROUND(AVG(retention_pct), 4) AS avg_retention_pct, COUNT(*) AS n_cohorts "
            "FROM retention GROUP BY month_number"
        ),
        "cohort_heatmap": _with(_heatmap()),
        "ab_readout": _with("SELECT * FROM readout"),
        "ab_ztest": _with("SELECT * FROM ab"),
        "ab_ztest_by_channel": _with(_published("ab_stats_ch", "channel")),
        "ab_power": _with(_power()),
        "ab_whatif_by_channel": _with(_whatif()),
        "ab_summary_text": _with(_summary_text()),
        "revenue_by_channel": _with("SELECT * FROM revenue"),
        "revenue_share": _with(
            f"SELECT channel, total_revenue_usd, ROUND({D} * total_revenue_usd / "
            "NULLIF(SUM(total_revenue_usd) OVER (), 0), 2) AS revenue_share_pct FROM revenue"
        ),
        "revenue_labelled": _with(
            f"SELECT channel, {_initcap(REPLACE_UNDERSCORES)} AS channel_name, "
            f"{_channel_label('channel')} AS channel_label, revenue_per_signup_usd FROM revenue",
            users=named,
        ),
        "channel_labels": _with(f"SELECT channel, {_channel_label('channel')} AS channel_label, signups FROM funnel", users=named),
        "dq_user_pk": _with("SELECT * FROM dq_pk"),
        "dq_events_fk": _with("SELECT * FROM dq_efk"),
        "dq_subscriptions_fk": _with("SELECT * FROM dq_sfk"),
        "dq_event_temporal": _with("SELECT * FROM dq_temporal"),
        "dq_non_null": _with("SELECT * FROM dq_nulls"),
        "dq_report": _with("SELECT * FROM dq_report"),
        "dq_report_failing": _with("SELECT * FROM dq_report", users=REPEATED_USERS),
        "dq_all_passed": _with("SELECT bool_and(passed) AS all_passed FROM dq_report"),
        "churn_features": _with("SELECT * FROM features"),
        "churn_scores": _with("SELECT * FROM scores"),
        "churn_tiers": _with(
            "SELECT user_id, channel, risk_score, CASE WHEN risk_score >= 70 THEN 'high' "
            "WHEN risk_score >= 40 THEN 'medium' ELSE 'low' END AS risk_tier FROM scores"
        ),
        "churn_rollup": _with("SELECT * FROM rollup"),
        "churn_rollup_repeated_keys": _with("SELECT * FROM rollup", users=REPEATED_USERS),
        "at_risk_users": _with(AT_RISK),
        "normalise_user_id": (
            f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, raw_id, "
            "TRY_CAST(COALESCE(NULLIF(ltrim(replace(lower(trim(raw_id, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), "
            "'user_', ''), '0'), ''), '1') AS BIGINT) "
            "AS user_id FROM (SELECT c_custkey, ' User_000' || CAST(c_custkey AS VARCHAR) || ' ' AS raw_id FROM customer)"
        ),
        "user_profile": _profile(uid),
        "user_timeline": _timeline(uid),
        "user_subscription": _subscription(sub_uid),
        "user_profile_by_text": _profile(typed),
        "user_timeline_by_text": _timeline(typed),
        "user_subscription_by_text": _subscription(typed),
        "user_journeys_events": _journeys_events(),
        "user_journeys": """
SELECT user_id, COUNT(*) AS n_events, COUNT(DISTINCT event_type) AS n_event_types,
       MIN(ts) AS first_event_at, MAX(ts) AS last_event_at,
       first(event_type ORDER BY ts, event_id) AS first_event,
       first(event_type ORDER BY ts DESC, event_id DESC) AS last_event
FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
        "adhoc_sql": _with(
            f"SELECT channel, COUNT(*) AS n_users FROM m_users GROUP BY channel HAVING COUNT(*) >= {params.min_users}"
        ),
        "result_search": _with(_result_search(params.search_term)),
        "result_search_indexed": _with(
            "SELECT * FROM m_events WHERE contains(lower(user_id || ' ' || event_name || ' ' || CAST(event_date AS VARCHAR)), "
            f"lower('{params.event_term}'))"
        ),
        "bucketed_funnel": _with("SELECT * FROM funnel"),
        "bucketed_revenue": _with("SELECT * FROM revenue"),
        "bucketed_ab_readout": _with("SELECT * FROM readout"),
        "bucketed_churn_features": _with("SELECT * FROM features"),
        "kpi_summary": _with(_kpi()),
        "payload_long": _with(_payload_long()),
        "kpi_summary_from_state": _with(_kpi()),
        "payload_from_state": _with(_payload_long()),
        "dq_report_from_state": _with("SELECT * FROM dq_report", users=LATER_USERS),
        "saved_funnel": _with("SELECT * FROM funnel"),
        "saved_cohort": _with("SELECT * FROM retention"),
        "saved_ab_test": _with("SELECT * FROM readout"),
        "saved_revenue": _with("SELECT * FROM revenue"),
        "layout_events": _with("SELECT * FROM m_events"),
        "layout_events_zorder": _with("SELECT * FROM m_events"),
        "replaced_users": _with("SELECT * FROM m_users"),
        "result_pages": _with(
            "SELECT *, row_number() OVER (ORDER BY user_id, event_date, event_name) - 1 AS row_number, "
            f"(row_number() OVER (ORDER BY user_id, event_date, event_name) - 1) // {params.page_size} AS page_number FROM m_events"
        ),
        "layout_users": _with("SELECT * FROM m_users"),
        "layout_subscriptions": _with("SELECT * FROM m_subscriptions"),
    }
