"""Named queries: key -> Spark DataFrame builder, and key -> oracle SQL.

Every query reads the stored tables of one data directory (or relations
Spark derives from them), so its work grows with the data; the fixed
parameters (a user id, a channel, a salt, a search term) only select or label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import hash_bucket, map_lookup, weighted_choice
from ..operators import churn, experiment, explore, flags, funnel, pages, quality, retention, revenue, state, summary, text_index
from ..session import new_path
from ..sources import buckets, sinks, snapshots, zorder
from ..sources.model import load_model, raw_event_log, register_model_views
from ..sources.tables import read_table
from . import catalog, oracle


@dataclass(frozen=True)
class Params:
    user_id: int = 8
    subscriber_id: int = 11
    channel: str = "BUILDING"
    salt: str = "exp1"
    min_users: int = 10
    search_term: str = "build"
    event_term: str = f"{K.EV_TRIAL} 1995-0".upper()
    typed_id: str = " user_0011 "
    page_size: int = 500
    tiers: tuple[tuple[float, str], ...] = ((50.0, "High Conv"), (45.0, "Converted"))


PARAMS = Params()
# The segments of the order tables under the channel names that have display labels.
SEGMENT_CHANNELS = dict(zip(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"), K.CHANNEL_LABELS))
Builder = Callable[[SparkSession, str], DataFrame]


def _m(fn):
    """Builder over the derived model (users, events, subscriptions), planned anew for each call."""
    return lambda spark, d: fn(load_model(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return raw_event_log(read_table(spark, d, "events"))


def _assignment(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return read_table(spark, d, "customer").select(
        key.cast("bigint").alias("user_id"),
        hash_bucket(key, PARAMS.salt).alias("assign_bucket"),
        weighted_choice(key, PARAMS.salt, K.EXPERIMENT_WEIGHTS).alias("experiment_group"),
        weighted_choice(key, "platform", K.PLATFORM_WEIGHTS).alias("platform"),
        weighted_choice(key, "channel", K.CHANNEL_WEIGHTS).alias("channel"),
        weighted_choice(key, "country", K.COUNTRY_WEIGHTS).alias("country"),
        weighted_choice(key, "plan", K.PLAN_WEIGHTS).alias("plan"),
    )


def _normalise(spark: SparkSession, d: str) -> DataFrame:
    cust = read_table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"))
    raw = cust.select("c_custkey", F.concat(F.lit(" User_000"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("raw_id"))
    return raw.select("c_custkey", "raw_id", explore.normalise_user_id(F.col("raw_id")).alias("user_id"))


def _with_views(spark: SparkSession, d: str):
    register_model_views(spark, load_model(spark, d))


def _adhoc(spark: SparkSession, d: str) -> DataFrame:
    _with_views(spark, d)
    return explore.adhoc_sql(
        spark,
        "SELECT channel, COUNT(*) AS n_users FROM m_users GROUP BY channel HAVING COUNT(*) >= :min_users",
        {"min_users": PARAMS.min_users},
    )


def _saved(name: str) -> Builder:
    def build(spark: SparkSession, d: str) -> DataFrame:
        _with_views(spark, d)
        return catalog.run_saved(spark, name)

    return build


def _named(m):
    """The model with its five segments under the names of the five channels."""
    return m._replace(users=m.users.withColumn("channel", map_lookup("channel", SEGMENT_CHANNELS)))


def _repeated(m):
    """All subscriptions as the users relation: repeated keys, users who never subscribed are unknown, and events
    precede the date."""
    none = F.lit(None).cast("string")
    return m.subscriptions.select(
        "user_id", F.col("subscribed_date").alias("signup_date"), F.col("plan").alias("channel"),
        none.alias("platform"), none.alias("country"), none.alias("experiment_group"),
    )


def _early(m):
    """The model with signups a month later, so that events precede them."""
    return m._replace(users=m.users.withColumn("signup_date", F.col("signup_date") + F.expr("INTERVAL 30 DAYS")))


def _layout(table: str, write) -> Builder:
    """Write the relation's layout and read it back."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        path = new_path(spark, "layout")
        relation = getattr(load_model(spark, d), table)
        write(relation, path)
        return spark.read.parquet(path).select(*relation.columns)

    return build


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    """Users stored as a table that is then replaced by a query on itself."""
    table = new_path(spark, "users-table")
    sinks.write_table(load_model(spark, d).users.withColumn("country", F.lower("country")), table)
    sinks.write_table(snapshots.read(spark, table).withColumn("country", F.upper("country")), table)
    snapshots.expire(spark, table, keep=1)
    return snapshots.read(spark, table)


def _pages(m):
    """All events in order as a stored result, with row and page numbers."""
    return pages.numbered(pages.store(m.events.orderBy("user_id", "event_date", "event_name")), PARAMS.page_size)


def _search(m):
    """A term in all events by an index of the stored result."""
    result = pages.store(m.events)
    text_index.build(result)
    return text_index.search(result, PARAMS.event_term)


def _bucketed(fn):
    """Builder over the model stored in buckets by user."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        base = new_path(spark, "buckets")
        buckets.write_model(load_model(spark, d), base)
        return fn(buckets.read_model(spark, base))

    return build


def _funnel(m):
    return funnel.funnel_by_channel(m.users, m.events)


def _retention(m):
    return retention.cohort_retention(m.users, m.events)


def _revenue(m):
    return revenue.revenue_by_channel(m.users, m.subscriptions)


def _scores(m):
    return churn.churn_scores(churn.churn_features(m.users, m.events))


QUERIES: dict[str, Builder] = {
    # sources and model
    "model_users": _m(lambda m: m.users),
    "model_events": _m(lambda m: m.events),
    "model_subscriptions": _m(lambda m: m.subscriptions),
    "table_counts": _m(lambda m: explore.table_counts(
        {"users": m.users, "events": m.events, "subscriptions": m.subscriptions})),
    "experiment_assignment": _assignment,
    # funnel
    "user_activity_flags": _m(lambda m: flags.user_activity_flags(m.users, m.events)),
    "funnel_by_channel": _m(_funnel),
    "funnel_for_channel": _m(lambda m: funnel.filter_segment(_funnel(m), PARAMS.channel)),
    "conversion_tiers": _m(lambda m: funnel.conversion_tiers(_funnel(m))),
    "funnel_long": _m(lambda m: funnel.funnel_long(_funnel(m))),
    "event_counts": lambda s, d: _events(s, d).groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count")).orderBy(
        F.desc("event_count"), F.asc("event_name")),
    "conversion_tiers_custom": _m(lambda m: funnel.conversion_tiers(_funnel(m), tiers=PARAMS.tiers)),
    "channel_labels": _m(lambda m: funnel.channel_labels(_funnel(_named(m)))),
    # retention
    "cohort_size": _m(lambda m: retention.cohort_size(m.users)),
    "cohort_retention": _m(_retention),
    "retention_curve": _m(lambda m: retention.retention_curve(_retention(m))),
    "cohort_heatmap": _m(lambda m: retention.cohort_heatmap(_retention(m))),
    # experiments
    "ab_readout": _m(lambda m: experiment.ab_readout(m.users, m.events)),
    "ab_ztest": _m(lambda m: experiment.ab_ztest(m.users, m.events)),
    "ab_ztest_by_channel": _m(lambda m: experiment.ab_ztest(m.users, m.events, segments=["channel"])),
    "ab_power": _m(lambda m: experiment.ab_power(m.users, m.events)),
    "ab_whatif_by_channel": _m(lambda m: experiment.ab_whatif(m.users, m.events)),
    "ab_summary_text": _m(lambda m: experiment.ab_summary_text(m.users, m.events)),
    # revenue
    "revenue_by_channel": _m(_revenue),
    "revenue_share": _m(lambda m: revenue.revenue_share(_revenue(m))),
    "revenue_labelled": _m(lambda m: revenue.revenue_labelled(_revenue(_named(m)))),
    # data quality
    "dq_user_pk": _m(lambda m: quality.user_pk_duplicates(m.users)),
    "dq_events_fk": _m(lambda m: quality.orphan_rows(m.events, m.users)),
    "dq_subscriptions_fk": _m(lambda m: quality.orphan_rows(m.subscriptions, m.users)),
    "dq_event_temporal": _m(lambda m: quality.events_before_signup(m.users, m.events)),
    "dq_non_null": _m(lambda m: quality.mandatory_nulls(*m)),
    "dq_report": _m(lambda m: quality.quality_report(*m)),
    "dq_all_passed": _m(lambda m: quality.all_passed(quality.quality_report(*m))),
    "dq_report_failing": _m(lambda m: quality.quality_report(_repeated(m), m.events, m.subscriptions)),
    # churn
    "churn_features": _m(lambda m: churn.churn_features(m.users, m.events)),
    "churn_scores": _m(_scores),
    "churn_tiers": _m(lambda m: churn.churn_tiers(_scores(m))),
    "churn_rollup": _m(lambda m: churn.churn_rollup(_scores(m))),
    "churn_rollup_repeated_keys": _m(lambda m: churn.churn_rollup(churn.churn_scores(churn.churn_features(_repeated(m), m.events)))),
    "at_risk_users": _m(lambda m: churn.at_risk_users(_scores(m))),
    # exploration
    "normalise_user_id": _normalise,
    "user_profile": _m(lambda m: explore.user_profile(m.users, PARAMS.user_id)),
    "user_timeline": lambda s, d: explore.user_timeline(_events(s, d), PARAMS.user_id, ("event_id",)),
    "user_subscription": _m(lambda m: explore.user_subscription(m.users, m.subscriptions, PARAMS.subscriber_id)),
    "user_profile_by_text": _m(lambda m: explore.user_profile(m.users, PARAMS.typed_id)),
    "user_timeline_by_text": lambda s, d: explore.user_timeline(_events(s, d), PARAMS.typed_id, ("event_id",)),
    "user_subscription_by_text": _m(lambda m: explore.user_subscription(m.users, m.subscriptions, PARAMS.typed_id)),
    "user_journeys_events": _m(lambda m: explore.user_journeys_events(*m)),
    "user_journeys": lambda s, d: explore.user_journeys(_events(s, d)),
    "adhoc_sql": _adhoc,
    "saved_funnel": _saved("funnel"),
    "saved_cohort": _saved("cohort"),
    "saved_ab_test": _saved("ab_test"),
    "saved_revenue": _saved("revenue"),
    "result_search_indexed": _m(_search),
    "result_search": _m(lambda m: explore.result_search(_funnel(m), PARAMS.search_term)),
    # summary
    "kpi_summary": _m(summary.kpi_summary),
    "dashboard_payload": _m(lambda m: summary.dashboard_payload(m, catalog.SAVED_SQL)),
    "payload_long": _m(summary.payload_long),
    "kpi_summary_from_state": lambda s, d: state.in_two_steps(load_model(s, d), new_path(s, "kept")).kpi_summary(),
    "payload_from_state": lambda s, d: summary.payload_long(None, state.in_two_steps(load_model(s, d), new_path(s, "kept")).analyses()),
    "dq_report_from_state": lambda s, d: state.in_two_steps(_early(load_model(s, d)), new_path(s, "kept")).analyses().report,
    # stored layouts, written and read back
    "layout_events": _layout("events", sinks.write_event_layout),
    "layout_users": _layout("users", sinks.write_user_layout),
    "layout_events_zorder": _layout("events", zorder.write),
    "replaced_users": _replaced,
    "bucketed_funnel": _bucketed(_funnel),
    "bucketed_revenue": _bucketed(_revenue),
    "bucketed_ab_readout": _bucketed(lambda m: experiment.ab_readout(m.users, m.events)),
    "bucketed_churn_features": _bucketed(lambda m: churn.churn_features(m.users, m.events)),
    "result_pages": _m(_pages),
    "layout_subscriptions": _layout("subscriptions", sinks.write_subscription_layout),
}

# Keys checked by row count only (no SQL restatement).
ROWS_ONLY = ("dashboard_payload",)


def queries() -> dict[str, Builder]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    sql = oracle.oracle_queries(PARAMS)
    return {k: sql[k] for k in QUERIES if k in sql}
