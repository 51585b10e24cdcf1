"""Revenue segmentation.

Subscriptions are reduced to one row per user before the join (so a user
with many subscriptions never multiplies join rows), prices are summed as
DECIMAL(28,8), wide enough to keep them as they are, so totals do not depend on
partitioning, then cast to double for the ratios and rounded last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import map_lookup


def revenue_by_channel(
    users: DataFrame, subscriptions: DataFrame, segment: str = "channel", annual_plan: str = K.ANNUAL_PLAN
) -> DataFrame:
    """segment, total_signups, paying_users, total_revenue_usd, revenue_per_signup_usd,
    pct_revenue_from_annual; best revenue per signup first.

    A segment without subscriptions has NULL revenue (not 0).
    """
    # users rows counted per (segment, user): copies collapse map-side and
    # weight the revenue, as each copied row would repeat it in the joined SUM
    weighted = users.groupBy(segment, "user_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = weighted.join(subscriptions_per_user(subscriptions, annual_plan), "user_id", "left")
    return revenue_table(joined, segment)


def subscriptions_per_user(
    subscriptions: DataFrame, annual_plan: str = K.ANNUAL_PLAN, extra: Sequence[Column] = (), nameless: bool = False
) -> DataFrame:
    """(user_id, rev, annual_rev, n_subs, extra...): prices summed as DECIMAL(28,8); with ``nameless`` also a row for
    the subscriptions without a user_id."""
    price = F.col("price_usd").cast("decimal(28,8)")
    return (
        (subscriptions if nameless else subscriptions.where(F.col("user_id").isNotNull()))
        .groupBy("user_id")
        .agg(
            F.sum(price).alias("rev"),
            F.sum(F.when(F.col("plan") == annual_plan, price).otherwise(F.lit(0))).alias("annual_rev"),
            F.count(F.lit(1)).alias("n_subs"),
            *extra,
        )
    )


def revenue_table(joined: DataFrame, segment: str = "channel", ordered: bool = True) -> DataFrame:
    """From (segment, user_id, copies) rows LEFT JOIN ``subscriptions_per_user``.

    ``copies`` is the number of users rows a row stands for.
    """
    # (segment, user) level: one row per user like COUNT(DISTINCT), revenue
    # counted once per users row as in the joined SUM. Clustered like the
    # user_id join before it, so no exchange.
    per_member = (
        joined
        .groupBy(segment, "user_id")
        .agg(
            F.sum(F.col("rev") * F.col("copies")).alias("rev"),
            F.sum(F.coalesce(F.col("annual_rev"), F.lit(0)) * F.col("copies")).alias("annual_rev"),
            F.max(F.when(F.col("n_subs").isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias("paying"),
        )
    )
    seg = per_member.groupBy(segment).agg(
        F.count("user_id").alias("total_signups"),
        F.sum("paying").cast("bigint").alias("paying_users"),
        F.sum("rev").cast("double").alias("rev"),
        F.sum("annual_rev").cast("double").alias("annual_rev"),
    )
    return revenue_rates(seg, segment, ordered)


def revenue_rates(seg: DataFrame, segment: str = "channel", ordered: bool = True) -> DataFrame:
    """From (segment, total_signups, paying_users, rev, annual_rev), doubles."""
    table = seg.select(
        segment,
        "total_signups",
        "paying_users",
        F.round("rev", 2).alias("total_revenue_usd"),
        F.round(F.col("rev") / F.nullif(F.col("total_signups"), F.lit(0)), 3).alias("revenue_per_signup_usd"),
        F.round(F.col("annual_rev") / F.nullif(F.col("rev"), F.lit(0.0)) * F.lit(100.0), 1).alias("pct_revenue_from_annual"),
    )
    return table.orderBy(F.desc_nulls_last("revenue_per_signup_usd"), F.asc(segment)) if ordered else table


def revenue_share(revenue: DataFrame, segment: str = "channel") -> DataFrame:
    """Each segment's share of total revenue (2 dp).

    The window spans all rows, which is one partition; its input is the
    per-segment aggregate (one row per channel), never the raw data.
    """
    total = F.sum("total_revenue_usd").over(Window.partitionBy())
    return revenue.select(
        segment, "total_revenue_usd",
        F.round(F.lit(100.0) * F.col("total_revenue_usd") / F.nullif(total, F.lit(0.0)), 2).alias("revenue_share_pct"),
    )


def display_name(c: str):
    """Underscores to spaces, then title case."""
    return F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))


def revenue_labelled(revenue: DataFrame, segment: str = "channel") -> DataFrame:
    return revenue.select(
        segment, display_name(segment).alias("channel_name"),
        map_lookup(segment, K.CHANNEL_LABELS).alias("channel_label"),
        "revenue_per_signup_usd",
    ).orderBy(F.desc_nulls_last("revenue_per_signup_usd"), F.asc(segment))
