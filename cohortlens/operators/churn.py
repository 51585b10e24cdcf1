"""Rule-based churn risk (a fixed scoring rule, not a trained model)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .flags import ACTIVITY_FLAGS, activity_flags, people, zero_filled

FEATURE_COLUMNS = ("unique_events", "total_event_count") + tuple(c for c, _ in ACTIVITY_FLAGS)


def churn_features(users: DataFrame, events: DataFrame) -> DataFrame:
    """One row per user_id: channel, signup_date and the activity flags (zeros without events)."""
    joined = people(users).join(activity_flags(events), "user_id", "left")
    return joined.select("user_id", "channel", "signup_date", *zero_filled(FEATURE_COLUMNS))


def risk_score(
    onboarded: Column, edited: Column, trialed: Column, subscribed: Column, n_events: Column,
    base: float = K.CHURN_BASE, w_onboarded: float = K.CHURN_W_ONBOARDED, w_edited: float = K.CHURN_W_EDITED,
    w_trialed: float = K.CHURN_W_TRIALED, event_cap: int = K.CHURN_EVENT_CAP,
) -> Column:
    """base - weights x flags - min(events, cap); subscribed -> 0; clipped to [0, 100]."""
    raw = (
        F.lit(base)
        - onboarded * F.lit(w_onboarded)
        - edited * F.lit(w_edited)
        - trialed * F.lit(w_trialed)
        - F.least(n_events, F.lit(event_cap)) * F.lit(1.0)
    )
    masked = F.when(subscribed == 1, F.lit(0.0)).otherwise(raw)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), masked))


def churn_scores(features: DataFrame) -> DataFrame:
    return features.select(
        "user_id", "channel", "has_onboarded", "has_edited", "has_trialed", "is_subscribed", "total_event_count",
        risk_score(
            F.col("has_onboarded"), F.col("has_edited"), F.col("has_trialed"), F.col("is_subscribed"),
            F.col("total_event_count"),
        ).alias("risk_score"),
    )


def risk_tier(score: Column) -> Column:
    return (
        F.when(score >= K.CHURN_HIGH, F.lit("high"))
        .when(score >= K.CHURN_MEDIUM, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def churn_tiers(scores: DataFrame) -> DataFrame:
    return scores.select("user_id", "channel", "risk_score", risk_tier(F.col("risk_score")).alias("risk_tier"))


def churn_rollup(scores: DataFrame) -> DataFrame:
    """Users per tier and mean score (1 dp); zeros for empty input."""
    s = F.col("risk_score")
    return scores.agg(
        F.count_if(s >= K.CHURN_HIGH).alias("high_risk_count"),
        F.count_if((s >= K.CHURN_MEDIUM) & (s < K.CHURN_HIGH)).alias("medium_risk_count"),
        F.count_if(s < K.CHURN_MEDIUM).alias("low_risk_count"),
        F.coalesce(F.round(F.avg(s), 1), F.lit(0.0)).alias("avg_churn_risk_pct"),
    )


def at_risk_users(scores: DataFrame, k: int = K.AT_RISK_TOP_K) -> DataFrame:
    """Top-k unsubscribed users by risk (ties by user_id); planned as a top-k, not a full sort."""
    return (
        scores.where(F.col("is_subscribed") == 0)
        .orderBy(F.desc("risk_score"), F.asc("user_id"))
        .limit(k)
        .select("user_id", "channel", "risk_score", "has_onboarded", "has_edited")
    )
