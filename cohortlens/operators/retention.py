"""Monthly cohort retention.

The month number is the number of whole 30.4-day periods between the first
day of the activity month and the first day of the signup month, truncated
toward zero (so a 30-day month yields 0 and activity in a short month before
signup also falls into 0). This is intentionally not calendar months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import pct
from ..functions.months import active_numbers, month_bits, slots_around


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "MM")


def month_number(event_month: Column, signup_month: Column, days: float = K.DAYS_PER_MONTH_BUCKET) -> Column:
    return (F.datediff(event_month, signup_month) / F.lit(float(days))).cast("int")


def cohorts(users: DataFrame) -> DataFrame:
    return users.select(
        "user_id",
        F.date_format("signup_date", "yyyy-MM").alias("cohort_month"),
        month_start(F.col("signup_date")).alias("signup_month"),
    )


def cohort_size(users: DataFrame) -> DataFrame:
    return cohorts(users).groupBy("cohort_month").agg(F.countDistinct("user_id").alias("cohort_users"))


def cohort_retention(
    users: DataFrame,
    events: DataFrame,
    activity_event: str = K.EV_APP_OPEN,
    months: Sequence[int] = K.RETENTION_MONTHS,
    days: float = K.DAYS_PER_MONTH_BUCKET,
    ordered: bool = True,
) -> DataFrame:
    """cohort_month, cohort_users, month_number, retained_users, retention_pct.

    Plan: each user's months of activity are bits of a few longs (``functions.months``), put together map-side, and
    each user's signup months one small set, so a hot user or a user key copied often is one row a task. Both lie
    by user_id for the join; a cohort's cells are bit tests, and its size and all its cells are
    counted in one aggregate: four exchanges with the order. Absent cells stay absent rows. The first and last
    signup month are read while the plan is built.
    """
    dated = users.where(F.col("user_id").isNotNull() & F.col("signup_date").isNotNull())
    slots = slots_around(dated, "signup_date", months, days)
    bits = events.where((F.col("event_name") == activity_event) & F.col("user_id").isNotNull()).groupBy("user_id")
    bits = bits.agg(*(month_bits(F.col("event_date"), F.lit(True), slots) or [F.lit(None).alias("none")]))
    # a signup month for each distinct one of the copies of a user key
    starts = dated.groupBy("user_id").agg(F.collect_set(month_start(F.col("signup_date"))).alias("starts"))
    member = starts.join(bits, "user_id", "left").withColumn("start", F.explode("starts"))
    member = member.withColumn("active", active_numbers(F.col("start"), months, days, slots))
    flags = [F.count_if(F.array_contains("active", F.lit(n))).alias(f"n{i}") for i, n in enumerate(months)]
    cells = member.groupBy(F.date_format("start", "yyyy-MM").alias("cohort_month")).agg(F.count(F.lit(1)).alias("cohort_users"), *flags)
    listed = F.array(*(F.struct(F.lit(n).alias("month_number"), F.col(f"n{i}").alias("retained_users")) for i, n in enumerate(months)))
    found = cells.select("cohort_month", "cohort_users", F.explode(F.filter(listed, lambda c: c["retained_users"] > 0)).alias("c"))
    table = with_pct(found.select("cohort_month", "cohort_users", "c.month_number", "c.retained_users"))
    return table.orderBy("cohort_month", "month_number") if ordered else table


def with_pct(cells: DataFrame) -> DataFrame:
    return cells.select(
        "cohort_month", "cohort_users", "month_number", "retained_users",
        pct("retained_users", "cohort_users", 1).alias("retention_pct"),
    )


def retention_table(retained: DataFrame, sizes: DataFrame) -> DataFrame:
    """From (cohort_month, month_number, retained_users) and (cohort_month, cohort_users)."""
    return with_pct(retained.join(sizes, "cohort_month"))


def retention_curve(retention: DataFrame) -> DataFrame:
    """Unweighted mean of the rounded cohort percentages per month number."""
    return (
        retention.groupBy("month_number")
        .agg(F.round(F.avg("retention_pct"), 4).alias("avg_retention_pct"), F.count(F.lit(1)).alias("n_cohorts"))
        .orderBy("month_number")
    )


def heat_class(v: Column) -> Column:
    return (
        F.when(v >= K.HEAT_HIGH, F.lit("high"))
        .when(v >= K.HEAT_MID, F.lit("mid"))
        .when(v.isNotNull(), F.lit("low"))
    )


def cohort_heatmap(retention: DataFrame, months: Sequence[int] = K.RETENTION_MONTHS) -> DataFrame:
    """One row per cohort, a percentage and a heat class per month number."""
    wide = (
        retention.groupBy("cohort_month", "cohort_users")
        .pivot("month_number", list(months))
        .agg(F.max("retention_pct"))
    )
    pcts = [F.col(f"`{m}`").alias(f"m{m}") for m in months]
    classes = [heat_class(F.col(f"`{m}`")).alias(f"m{m}_class") for m in months]
    return wide.select("cohort_month", "cohort_users", *pcts, *classes).orderBy("cohort_month")
