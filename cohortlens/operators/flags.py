"""Per-user activity flags and per-segment distinct-user counts.

All funnel/readout/churn analyses reduce the event log to one row per user
first (one shuffle on ``user_id`` with map-side partial aggregation, so a user
with a huge share of the events costs one partial row per map task), and only
then join the much smaller per-user rows to ``users``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

ACTIVITY_FLAGS = (
    ("has_onboarded", K.EV_ONBOARDED),
    ("has_edited", K.EV_EDITED),
    ("has_trialed", K.EV_TRIAL),
    ("is_subscribed", K.EV_SUBSCRIBED),
)


def _flag(event: str):
    return F.when(F.col("event_name") == event, F.lit(1)).otherwise(F.lit(0))


def stage_flags(events: DataFrame, stages: Sequence[tuple[str, str]]) -> DataFrame:
    """(user_id, <flag>...) for users having at least one of the stage events.

    Only the stage events are shuffled (the filter runs before the exchange).
    """
    names = sorted({ev for _, ev in stages})
    return (
        events.where(F.col("user_id").isNotNull() & F.col("event_name").isin(names))
        .groupBy("user_id")
        .agg(*[F.max(_flag(ev)).alias(col) for col, ev in stages])
    )


def activity_flags(
    events: DataFrame, flags: Sequence[tuple[str, str]] = ACTIVITY_FLAGS, extra: Sequence[Column] = (), nameless: bool = False,
    unique: bool = True,
) -> DataFrame:
    """Per user with events: distinct event names, event count, 0/1 flags and ``extra`` aggregates; with
    ``nameless`` also a row for the events without a user_id, without ``unique`` no distinct names (and no shuffle for them)."""
    return (
        (events if nameless else events.where(F.col("user_id").isNotNull()))
        .groupBy("user_id")
        .agg(
            *([F.countDistinct("event_name").alias("unique_events")] if unique else []),
            F.count("event_name").alias("total_event_count"),
            F.count(F.lit(1)).alias("event_rows"),
            *[F.max(_flag(ev)).alias(col) for col, ev in flags],
            *extra,
        )
    )


def people(users: DataFrame) -> DataFrame:
    """One row per user_id: ``copies`` rows it stands for, least channel and signup date.

    The analyses per user group the joined rows by user_id: a user key that is repeated is one
    user, whose events count once per copy.
    """
    return users.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("channel").alias("channel"), F.min("signup_date").alias("signup_date")
    )


def user_activity_flags(
    users: DataFrame, events: DataFrame, flags: Sequence[tuple[str, str]] = ACTIVITY_FLAGS
) -> DataFrame:
    """One row per user_id; users without events get zeros (LEFT JOIN semantics)."""
    joined = people(users).join(activity_flags(events, flags), "user_id", "left")
    return joined.select("user_id", *zero_filled(["unique_events", "total_event_count"] + [c for c, _ in flags]))


def zero_filled(columns: Sequence[str]) -> list[Column]:
    """The columns of users LEFT JOIN ``activity_flags``: NULL is 0, events count once per copy."""
    value = {c: F.coalesce(F.col(c), F.lit(0)) for c in columns}
    return [(v * F.col("copies") if c == "total_event_count" else v).alias(c) for c, v in value.items()]


def segment_counts(joined: DataFrame, segment_cols: Sequence[str], flag_cols: Sequence[str]) -> DataFrame:
    """Per segment: distinct users and distinct users with each flag.

    ``joined`` has the segment columns, ``user_id`` and nullable 0/1 flag
    columns (user rows LEFT JOIN per-user flags). Equals ``COUNT(DISTINCT
    u.user_id)`` and ``COUNT(DISTINCT CASE WHEN ... THEN e.user_id END)`` over
    ``users LEFT JOIN events`` without the Expand of a multi-distinct
    aggregate: the first aggregate keeps one row per (segment, user) and is
    clustered like the ``user_id`` join before it (no exchange); the second is
    a small partial/final aggregate.
    """
    per_user = joined.groupBy(*segment_cols, "user_id").agg(
        *[F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in flag_cols]
    )
    return per_user.groupBy(*segment_cols).agg(
        F.count("user_id").alias("users"),
        *[F.sum(c).cast("bigint").alias(c) for c in flag_cols],
    )


def members(users: DataFrame, segment_cols: Sequence[str]) -> DataFrame:
    """Distinct (segment..., user_id) rows of ``users``.

    Copies of a user key collapse in the map-side partial aggregate, so a key
    repeated over a large share of the users rows never reaches one join task.
    """
    return users.select(*segment_cols, "user_id").distinct()


def segment_user_counts(
    users: DataFrame, flags: DataFrame, segment_cols: Sequence[str], flag_cols: Sequence[str]
) -> DataFrame:
    """``segment_counts`` of distinct (segment, user) rows LEFT JOIN per-user flags."""
    joined = members(users, segment_cols).join(flags, "user_id", "left")
    return segment_counts(joined, segment_cols, flag_cols)
