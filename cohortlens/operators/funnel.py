"""Acquisition funnel by segment (stages counted independently, not nested)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import map_lookup, pct
from .flags import segment_user_counts, stage_flags

RATE_COLUMNS = (
    # (output, numerator, denominator, digits)
    ("pct_onboarded", "onboarded", "signups", 1),
    ("pct_onboarded_to_edit", "edited", "onboarded", 1),
    ("pct_edit_to_trial", "trialed", "edited", 1),
    ("pct_trial_to_paid", "subscribed", "trialed", 1),
    ("overall_conversion_pct", "subscribed", "signups", 2),
)
FUNNEL_COLUMNS = (
    "signups", "onboarded", "pct_onboarded", "edited", "pct_onboarded_to_edit", "trialed",
    "pct_edit_to_trial", "subscribed", "pct_trial_to_paid", "overall_conversion_pct",
)


def funnel_counts(
    users: DataFrame,
    events: DataFrame,
    segment: str = "channel",
    stages: Sequence[tuple[str, str]] = K.FUNNEL_STAGES,
) -> DataFrame:
    """segment, signups, <stage>...: distinct users per segment and per stage."""
    flags = stage_flags(events, stages)
    counts = segment_user_counts(users, flags, [segment], [c for c, _ in stages])
    return counts.withColumnRenamed("users", "signups")


def funnel_by_channel(users: DataFrame, events: DataFrame, segment: str = "channel") -> DataFrame:
    """Funnel with step rates (1 dp) and overall conversion (2 dp), best first.

    A zero denominator gives NULL instead of an error.
    """
    return funnel_table(funnel_counts(users, events, segment), segment)


def funnel_table(counts: DataFrame, segment: str = "channel", ordered: bool = True) -> DataFrame:
    """Rates (and, if ``ordered``, the best-first order) from (segment, signups, <stage>...) counts."""
    rates = {out: pct(num, den, d) for out, num, den, d in RATE_COLUMNS}
    cols = [rates[c].alias(c) if c in rates else F.col(c) for c in FUNNEL_COLUMNS]
    table = counts.select(segment, *cols)
    return table.orderBy(F.desc_nulls_last("overall_conversion_pct"), F.asc(segment)) if ordered else table


def filter_segment(funnel: DataFrame, value: str | None, segment: str = "channel") -> DataFrame:
    """One segment, or all when ``value`` is None (the filter reaches the user scan)."""
    return funnel if value is None else funnel.where(F.col(segment) == F.lit(value))


def conversion_tier(overall: Column, tiers: Sequence[tuple[float, str]] = K.CONVERSION_TIERS) -> Column:
    """The label of the first bound that is exceeded (bounds from high to low), else the default."""
    expr = None
    for bound, label in tiers:
        expr = F.when(overall > bound, F.lit(label)) if expr is None else expr.when(overall > bound, F.lit(label))
    return expr.otherwise(F.lit(K.CONVERSION_TIER_DEFAULT))


def conversion_tiers(
    funnel: DataFrame, segment: str = "channel", tiers: Sequence[tuple[float, str]] = K.CONVERSION_TIERS
) -> DataFrame:
    tier = conversion_tier(F.col("overall_conversion_pct"), tiers)
    return funnel.select(segment, "overall_conversion_pct", tier.alias("conversion_tier"))


def funnel_long(funnel: DataFrame, segment: str = "channel") -> DataFrame:
    """Segment x stage long form with the share of signups reaching the stage."""
    stages = ["signups"] + [c for c, _ in K.FUNNEL_STAGES]
    args = ", ".join(f"'{s}', {i}, {s}" for i, s in enumerate(stages, start=1))
    long = funnel.select(
        segment, "signups", F.expr(f"stack({len(stages)}, {args}) AS (stage, stage_order, users)")
    )
    return long.select(
        segment, "stage", F.col("stage_order").cast("int").alias("stage_order"), "users",
        pct("users", "signups", 1).alias("pct_of_signups"),
    )


def channel_labels(df: DataFrame, segment: str = "channel") -> DataFrame:
    """Adds the display name of each channel (unknown names pass through)."""
    return df.select(segment, map_lookup(segment, K.CHANNEL_LABELS).alias("channel_label"), "signups")
