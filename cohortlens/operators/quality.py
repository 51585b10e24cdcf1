"""Data-quality checks on users / events / subscriptions.

Each check is a one-row aggregate; the report derives them from one stored row per user.
Foreign-key checks reduce the child table to one row per key (partial
aggregation) and anti-join distinct keys, so a key holding a large share of
the rows skews neither side of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import stored


def user_pk_duplicates(users: DataFrame) -> DataFrame:
    """COUNT(user_id) - COUNT(DISTINCT user_id); NULL keys are not counted here."""
    return users.agg((F.count("user_id") - F.countDistinct("user_id")).alias("duplicate_count"))


def rows_per_user(child: DataFrame) -> DataFrame:
    """(user_id, n): rows per non-NULL key, partially aggregated map-side."""
    return child.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def orphan_rows(child: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of ``child`` whose non-NULL user_id is not in ``users``."""
    return orphans_from_counts(rows_per_user(child), users)


def orphans_from_counts(per_key: DataFrame, users: DataFrame) -> DataFrame:
    """Sum of ``n`` over the (user_id, n) rows whose key is not in ``users``."""
    # distinct keys: copies of a user collapse map-side, and the anti join
    # reuses this aggregate's user_id partitioning (no further exchange)
    keys = users.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    return _orphans_by_keys(per_key, keys)


def _orphans_by_keys(per_key: DataFrame, keys: DataFrame) -> DataFrame:
    return per_key.join(keys, "user_id", "left_anti").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_count")
    )


def events_before_signup(users: DataFrame, events: DataFrame) -> DataFrame:
    """Joined rows with event_date < signup_date (equal is allowed; NULL dates are not counted).

    Two steps: the first event of each user against the last signup date finds the users who break the
    rule; only their events are read again and counted.
    """
    last = users.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("signup_date").alias("last_signup"))
    first = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("event_date").alias("first_event"))
    broken = last.join(first, "user_id").where(F.col("first_event") < F.col("last_signup")).select("user_id")
    return count_early_events(users, events, stored(broken, "early_users"))


def count_early_events(users: DataFrame, events: DataFrame, broken: DataFrame) -> DataFrame:
    """One row, invalid_date_count, from the users who break the rule (a stored table of user_id).

    Users without a breach need no second look: with none the count is 0. Else ``early_pairs`` counts the breakers'
    events and signups by their dates.
    """
    if broken.isEmpty():
        return broken.agg(F.count(F.lit(1)).alias("invalid_date_count"))
    dates = (
        users.join(broken.hint("merge"), "user_id", "left_semi")
        .where(F.col("signup_date").isNotNull())
        .groupBy("user_id", "signup_date")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    dated = events.where(F.col("user_id").isNotNull() & F.col("event_date").isNotNull())
    return early_pairs(dates, dated.groupBy("user_id", "event_date").agg(F.count(F.lit(1)).alias("n")))


def early_pairs(dates: DataFrame, own: DataFrame) -> DataFrame:
    """One row, invalid_date_count, from (user_id, signup_date, copies) and (user_id, event_date, n).

    Events of an earlier day are counted by days, so a user with very many events brings one row a day to the join by
    user; those of the signup's own day meet it by user and day. Both sides may be as long as the users, and their
    files say little about their rows: neither join may broadcast.
    """
    dates, own = dates.withColumn("day", F.to_date("signup_date")), own.withColumn("day", F.to_date("event_date"))
    signup_days = dates.groupBy("user_id", F.col("day").alias("signup_day")).agg(F.sum("copies").alias("copies"))
    event_days = own.groupBy("user_id", "day").agg(F.sum("n").alias("n"))
    before = event_days.join(signup_days.hint("merge"), "user_id").where(F.col("day") < F.col("signup_day"))
    same_day = own.join(dates.hint("merge"), ["user_id", "day"]).where(F.col("event_date") < F.col("signup_date"))
    pairs = before.select("n", "copies").unionByName(same_day.select("n", "copies"))
    total = F.sum(F.col("n") * F.col("copies"))
    return pairs.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("invalid_date_count"))


def _any_null(*cols: str) -> Column:
    cond = None
    for c in cols:
        cond = F.col(c).isNull() if cond is None else (cond | F.col(c).isNull())
    return cond


def mandatory_nulls(users: DataFrame, events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    parts = [
        users.agg(F.count_if(_any_null("user_id", "signup_date", "channel")).alias("n")),
        events.agg(F.count_if(_any_null("user_id", "event_name", "event_date")).alias("n")),
        subscriptions.agg(F.count_if(_any_null("user_id", "price_usd")).alias("n")),
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return stacked.agg(F.sum("n").cast("bigint").alias("null_count"))


def user_profile(users: DataFrame, events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One stored row per user_id of any relation: rows, rows with a NULL, first event, last signup. One pass over
    each relation; NULL keys form a row of their own."""
    up = users.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.max("signup_date").alias("last_signup"),
        F.count_if(_any_null("user_id", "signup_date", "channel")).alias("bad_users"),
    )
    ep = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("event_date").alias("first_event"),
        F.count_if(_any_null("user_id", "event_name", "event_date")).alias("bad_events"),
    )
    sp = subscriptions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_bills"), F.count_if(_any_null("user_id", "price_usd")).alias("bad_bills")
    )
    return stored(up.join(ep, "user_id", "full_outer").join(sp, "user_id", "full_outer"), "user_profile")


def quality_report(users: DataFrame, events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """check_order, check_name, passed, details for the five checks, from one profile of all users, which is stored
    while the plan is built."""
    profile = user_profile(users, events, subscriptions)
    key = F.col("user_id").isNotNull()
    orphan = key & F.col("n_users").isNull()
    counts = profile.agg(
        F.sum(F.when(key, F.col("n_users") - 1)).alias("duplicate_count"),
        F.sum(F.when(orphan, F.col("n_events"))).alias("orphan_events"),
        F.sum(F.when(orphan, F.col("n_bills"))).alias("orphan_bills"),
        *(F.sum(c).alias(c) for c in ("bad_users", "bad_events", "bad_bills")),
    )
    broken = profile.where(key & (F.col("first_event") < F.col("last_signup"))).select("user_id")
    return report_table(counts, count_early_events(users, events, broken))


def report_table(counts: DataFrame, early: DataFrame) -> DataFrame:
    """The report from one row (duplicate_count, orphan_events, orphan_bills, bad...) and one of ``count_early_events``."""
    bad = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts.columns if c.startswith("bad")), F.lit(0))
    values = (("user_pk", F.col("duplicate_count")), ("events_fk", F.col("orphan_events")), ("subscriptions_fk", F.col("orphan_bills")), ("non_null", bad))
    order = list(K.DQ_CHECKS)
    found = counts.select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit(0)).cast("bigint").alias("n")) for k, v in values))).alias("x")
    ).select("x.key", "x.n")
    rows = found.unionByName(early.select(F.lit("event_temporal").alias("key"), F.col("invalid_date_count").alias("n")))
    n, key = F.col("n"), F.col("key")

    def of_key(values):
        out = F.lit(None)
        for k in order:
            out = F.when(key == k, values(k)).otherwise(out)
        return out

    ok = of_key(lambda k: F.lit(K.DQ_CHECKS[k][1]))
    failed = of_key(lambda k: F.format_string(K.DQ_CHECKS[k][2].replace("{}", "%d"), n))
    return rows.select(
        of_key(lambda k: F.lit(order.index(k) + 1)).alias("check_order"),
        of_key(lambda k: F.lit(K.DQ_CHECKS[k][0])).alias("check_name"),
        (n == 0).alias("passed"),
        F.when(n == 0, ok).otherwise(failed).alias("details"),
    )


def all_passed(report: DataFrame) -> DataFrame:
    return report.agg(F.bool_and("passed").alias("all_passed"))
