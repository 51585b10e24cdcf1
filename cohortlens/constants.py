"""Fixed values of the analytics domain.

Everything in this module must keep the exact values listed here for the
results to match the published goldens (event names, arm names, plan prices,
score weights, thresholds, labels, message texts, output formats). Functions
take these as default arguments so that callers can override them.
"""

# --- Fixed values: event vocabulary -------------------------------------------
EV_SIGNUP = "signup"
EV_ONBOARDED = "onboarding_complete"
EV_EDITED = "first_edit"
EV_TRIAL = "trial_started"
EV_SUBSCRIBED = "subscribed"
EV_APP_OPEN = "app_open"

# Funnel stages after signup, in display order: (output column, event name).
FUNNEL_STAGES = (
    ("onboarded", EV_ONBOARDED),
    ("edited", EV_EDITED),
    ("trialed", EV_TRIAL),
    ("subscribed", EV_SUBSCRIBED),
)

# --- Fixed values: experiment ---------------------------------------------------
ARM_CONTROL = "control_self_serve"
ARM_TREATMENT = "treatment_guided_edit"
ACTIVATION_EVENT = EV_ONBOARDED
ALPHA = 0.05
WHATIF_N_PER_ARM = 3000

# --- Fixed values: subscriptions --------------------------------------------------
PLAN_PRICES = {"monthly": 9.99, "annual": 79.99}
ANNUAL_PLAN = "annual"
FREE_TIER_LABEL = "Free Tier"

# --- Fixed values: weighted category assignment (value, weight) --------------------
EXPERIMENT_WEIGHTS = (("control_self_serve", 0.5), ("treatment_guided_edit", 0.5))
PLATFORM_WEIGHTS = (("iOS", 0.55), ("Android", 0.45))
CHANNEL_WEIGHTS = (
    ("organic_search", 0.30),
    ("paid_social", 0.28),
    ("referral", 0.15),
    ("influencer", 0.17),
    ("app_store_featured", 0.10),
)
COUNTRY_WEIGHTS = (
    ("US", 0.35),
    ("IN", 0.25),
    ("UK", 0.12),
    ("BR", 0.10),
    ("DE", 0.10),
    ("CA", 0.08),
)
PLAN_WEIGHTS = (("monthly", 0.65), ("annual", 0.35))

# --- Fixed values: retention ---------------------------------------------------------
DAYS_PER_MONTH_BUCKET = 30.4
RETENTION_MONTHS = (0, 1, 2, 3)
HEAT_HIGH = 50.0
HEAT_MID = 35.0

# --- Fixed values: conversion tiers (overall conversion %, strictly greater) ------------
CONVERSION_TIERS = ((10.0, "High Conv"), (5.0, "Converted"))
CONVERSION_TIER_DEFAULT = "Standard"

# --- Fixed values: channel display names (unknown channels pass through) ---------------
CHANNEL_LABELS = {
    "referral": "Referral",
    "organic_search": "Organic Search",
    "app_store_featured": "App Store",
    "paid_social": "Paid Social",
    "influencer": "Influencer",
}

# --- Fixed values: churn rule -------------------------------------------------------------
CHURN_BASE = 95.0
CHURN_W_ONBOARDED = 25.0
CHURN_W_EDITED = 30.0
CHURN_W_TRIALED = 30.0
CHURN_EVENT_CAP = 10
CHURN_HIGH = 70.0
CHURN_MEDIUM = 40.0
AT_RISK_TOP_K = 10

# --- Fixed values: data-quality check names and messages ({} = the count) ----------------
DQ_CHECKS = {
    "user_pk": (
        "User Primary Key Uniqueness",
        "0 duplicate user_ids found.",
        "{} duplicate user_ids detected!",
    ),
    "events_fk": (
        "Events Foreign Key Integrity",
        "0 orphan event records.",
        "{} orphan event records found!",
    ),
    "subscriptions_fk": (
        "Subscriptions Foreign Key Integrity",
        "0 orphan subscription records.",
        "{} orphan subscription records found!",
    ),
    "event_temporal": (
        "Event Temporal Consistency",
        "All events occur after or on signup date.",
        "{} events precede signup date!",
    ),
    "non_null": (
        "Mandatory Fields Non-Null Constraint",
        "0 null values in mandatory fields.",
        "{} null values in mandatory fields!",
    ),
}

# --- Fixed values: A/B text report line formats (printf style) ------------------------------
AB_TEXT_LINES = (
    "Control activation:   %.2f%% (n=%d)",
    "Treatment activation: %.2f%% (n=%d)",
    "Absolute lift:        %s%.2f pp",
    "Relative lift:        %s%.2f%%",
    "%d%% Confidence Int.:  [%.2f pp, %.2f pp]",
    "z-statistic:          %.3f",
    "p-value:              %.5f",
    "Cohen's h:            %.4f",
    "Result:               %s at %d%% confidence level",
)
AB_SIGNIFICANT = "SIGNIFICANT"
AB_NOT_SIGNIFICANT = "NOT SIGNIFICANT"
