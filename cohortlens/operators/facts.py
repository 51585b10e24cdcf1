"""One row per user for the summary, and one aggregate of these rows.

Each relation is first reduced to its users, in partial rows that can be put together again: ``people_rows`` (a row a
user and combination of dimensions, with its number of copies), ``act_rows`` and ``bill_rows`` (a row a user). ``facts_of``
joins the three in full, which keeps orphans, and holds a user's distinct dimensions as a small array: one row
a user, stored. ``summary_cells`` adds up everything that the summary shows (by channel, arm, cohort and in all)
in one aggregate: a user contributes once to each cell that its array names. No window, no distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.months import active_numbers, month_bits, slots_around, slots_in
from ..session import stored
from ..sources.model import Model
from .churn import risk_score
from .flags import activity_flags
from .retention import month_start
from .revenue import subscriptions_per_user

STAGES = (("onboarded", "has_onboarded"), ("edited", "has_edited"), ("trialed", "has_trialed"), ("subscribed", "is_subscribed"))
DIMENSIONS = ("channel", "experiment_group", "signup_month")


def people_rows(users: DataFrame) -> DataFrame:
    """user_id, channel, experiment_group, signup_month, copies, last_signup, bad_users."""
    return (
        users.withColumn("signup_month", month_start(F.col("signup_date")))
        .groupBy("user_id", *DIMENSIONS)
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.max("signup_date").alias("last_signup"),
            F.count_if(F.col("signup_date").isNull() | F.col("channel").isNull()).alias("bad_users"),
        )
    )


def act_rows(events: DataFrame, slots: Sequence[int]) -> DataFrame:
    """user_id (also NULL), counts and flags of its events, its first one, and its months of activity as bits."""
    return activity_flags(
        events,
        extra=(
            F.min("event_date").alias("first_event"),
            F.count_if(F.col("event_name").isNull() | F.col("event_date").isNull()).alias("bad_events"),
            *month_bits(F.col("event_date"), F.col("event_name") == K.EV_APP_OPEN, slots),
        ),
        nameless=True,
        unique=False,
    )


def bill_rows(subscriptions: DataFrame) -> DataFrame:
    """user_id (also NULL), rev, annual_rev, n_subs, bad_bills."""
    return subscriptions_per_user(subscriptions, extra=(F.count_if(F.col("price_usd").isNull()).alias("bad_bills"),), nameless=True)


def user_facts(model: Model) -> DataFrame:
    """The stored facts of a model. (The first and last signup month are read while the plan is built.)"""
    slots = slots_around(model.users, "signup_date", K.RETENTION_MONTHS, K.DAYS_PER_MONTH_BUCKET)
    return facts_of(people_rows(model.users), act_rows(model.events, slots), bill_rows(model.subscriptions))


def facts_of(people: DataFrame, acts: DataFrame, bills: DataFrame) -> DataFrame:
    """One stored row per user_id of any relation, and up to three for rows without one."""
    each = people.groupBy("user_id").agg(
        # as many entries as a user has distinct dimensions
        F.collect_list(F.struct(*DIMENSIONS, "copies")).alias("dims"),
        F.sum("copies").alias("all_copies"),
        F.min("channel").alias("one_channel"),
        F.max("last_signup").alias("last_signup"),
        F.sum("bad_users").alias("bad_users"),
    )
    # rows without a user_id meet no others
    joined = each.join(acts, "user_id", "full_outer").join(bills, "user_id", "full_outer")
    return stored(joined, "user_facts")


def scored(facts: DataFrame) -> DataFrame:
    """facts with the churn features and score of each user (as ``churn.churn_scores`` has them)."""
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for _, c in STAGES}
    count = F.coalesce(F.col("total_event_count"), F.lit(0)) * F.col("all_copies")
    score = risk_score(*(flags[c] for _, c in STAGES), count)
    return facts.withColumns(flags | {"risk_score": score})


def _cells(slots: Sequence[int]) -> Column:
    """The cells that a user belongs to: (kind, k1, k2, copies of its rows there)."""

    def cell(kind: str, k1: Column | None = None, k2: Column | None = None, copies: Column | None = None) -> Column:
        text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
        return F.struct(
            F.lit(kind).alias("kind"), (text if k1 is None else k1).alias("k1"), (number if k2 is None else k2).alias("k2"),
            (F.lit(None).cast("long") if copies is None else copies).alias("copies"),
        )

    def own(kind: str, field: str, text=lambda v: v) -> Column:
        def copies(value: Column) -> Column:
            return F.aggregate(F.filter("dims", lambda d: d[field].eqNullSafe(value)), F.lit(0).cast("long"), lambda a, d: a + d["copies"])

        values = F.array_distinct(F.transform("dims", lambda d: d[field]))
        return F.transform(values, lambda v: cell(kind, text(v), copies=copies(v)))

    def month(v: Column) -> Column:
        return F.date_format(v, "yyyy-MM")

    starts = F.array_distinct(F.transform("dims", lambda d: d["signup_month"]))

    def numbers(start: Column) -> Column:
        return active_numbers(start, K.RETENTION_MONTHS, K.DAYS_PER_MONTH_BUCKET, slots)

    active = F.flatten(F.transform(F.filter(starts, F.isnotnull), lambda m: F.transform(numbers(m), lambda n: cell("active", month(m), n))))
    every = F.array(cell("all", copies=F.col("all_copies")))
    dims = F.concat(every, own("channel", "channel"), own("group", "experiment_group"), own("cohort", "signup_month", month), active)
    return F.when(F.col("dims").isNotNull(), dims).otherwise(every)


def summary_cells(facts: DataFrame) -> DataFrame:
    """kind, k1, k2 and sums: 'all', 'channel', 'group', 'cohort' and 'active' (cohort, month number); stored. As many
    rows as there are channels, arms and cohort months."""
    named, person = F.col("user_id").isNotNull(), F.col("dims").isNotNull()
    churning = person & (F.col("cell.kind") == "all")  # users without a key are one user there
    score, copies = F.col("risk_score"), F.col("cell.copies")

    def total(value: Column, when: Column) -> Column:
        return F.sum(F.when(when, value))

    def count(when: Column) -> Column:
        return F.count_if(F.coalesce(when, F.lit(False)))

    def some(*columns: str) -> Column:
        return sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))

    rows = scored(facts).withColumn("cell", F.explode(_cells(slots_in(facts.columns))))
    member, orphan = person & named, named & ~person
    bad = some("bad_users", "bad_events", "bad_bills")
    return stored(
        rows.groupBy("cell.kind", "cell.k1", "cell.k2").agg(
            count(member).alias("users"),
            *(count(member & (F.col(c) == 1)).alias(n) for n, c in STAGES),
            total(F.col("rev") * copies, member).cast("double").alias("rev"),
            total(F.col("annual_rev") * copies, member).cast("double").alias("annual_rev"),
            count(member & F.col("n_subs").isNotNull()).alias("paying"),
            count(churning & (score >= K.CHURN_HIGH)).alias("high"),
            count(churning & (score >= K.CHURN_MEDIUM) & (score < K.CHURN_HIGH)).alias("medium"),
            count(churning & (score < K.CHURN_MEDIUM)).alias("low"),
            total(score, churning).alias("risk"),
            total(copies, member).alias("copies"),
            total(F.col("event_rows"), orphan).alias("orphan_events"),
            total(F.col("n_subs"), orphan).alias("orphan_bills"),
            # a row without a user_id is bad as such
            F.sum(F.when(named, bad).otherwise(some("all_copies", "event_rows", "n_subs"))).alias("bad"),
        ),
        "summary_cells",
    )
