"""Reference-shaped relations derived from the order tables.

The analyses work on three relations:

* ``users(user_id, signup_date, channel, platform, country, experiment_group)``
* ``events(user_id, event_name, event_date)``
* ``subscriptions(user_id, subscribed_date, plan, price_usd)``

The test data is an order schema, so these are derived from it by fixed rules
(customer = user, first order = signup, order priority/status = lifecycle
event, urgent fulfilled order = subscription). Every rule is a column
expression or an aggregate; nothing is materialised here, so Catalyst still
prunes columns and pushes filters through to the Parquet scans.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .tables import read_table

# Fixed values of the derivation rules.
PRIORITY_ONBOARDED = "4-NOT SPECIFIED"
PRIORITY_APP_OPEN = "5-LOW"
PRIORITY_EDITED = "3-MEDIUM"
PRIORITY_TRIAL = "2-HIGH"
PRIORITY_SUBSCRIBED = "1-URGENT"
STATUS_FULFILLED = "F"
PLATFORM_MOD, PLATFORM_IOS_BELOW = 20, 11
PLAN_MOD, PLAN_ANNUAL_BELOW = 20, 7


class Model(NamedTuple):
    users: DataFrame
    events: DataFrame
    subscriptions: DataFrame


def first_order_dates(orders: DataFrame) -> DataFrame:
    """(o_custkey, signup_date): partial aggregation absorbs customers with many orders."""
    return orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("signup_date"))


def derive_users(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    # one row a key, so that Catalyst leaves the join out where the country is not used
    nations = nation.groupBy("n_nationkey").agg(F.min("n_name").alias("n_name"))
    first = first_order_dates(orders)
    return (
        customer.select("c_custkey", "c_mktsegment", "c_nationkey")
        .join(first, key == first["o_custkey"], "left")
        .join(nations, F.col("c_nationkey") == nations["n_nationkey"], "left")
        .select(
            key.cast("bigint").alias("user_id"),
            F.col("signup_date"),
            F.col("c_mktsegment").alias("channel"),
            F.when(key % PLATFORM_MOD < PLATFORM_IOS_BELOW, F.lit("iOS")).otherwise(F.lit("Android")).alias("platform"),
            F.col("n_name").alias("country"),
            F.when(key % 2 == 0, F.lit(K.ARM_CONTROL)).otherwise(F.lit(K.ARM_TREATMENT)).alias("experiment_group"),
        )
    )


def order_event_name(priority: Column, status: Column) -> Column:
    return (
        F.when(priority == PRIORITY_ONBOARDED, F.lit(K.EV_ONBOARDED))
        .when((status != STATUS_FULFILLED) | (priority == PRIORITY_APP_OPEN), F.lit(K.EV_APP_OPEN))
        .when(priority == PRIORITY_EDITED, F.lit(K.EV_EDITED))
        .when(priority == PRIORITY_TRIAL, F.lit(K.EV_TRIAL))
        .when(priority == PRIORITY_SUBSCRIBED, F.lit(K.EV_SUBSCRIBED))
    )


def derive_events(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One signup per user at its first order, plus one lifecycle event per order."""
    first = first_order_dates(orders)
    signups = (
        customer.select("c_custkey")
        .join(first, F.col("c_custkey") == first["o_custkey"])
        .where(F.col("signup_date").isNotNull())
        .select(
            F.col("c_custkey").cast("bigint").alias("user_id"),
            F.lit(K.EV_SIGNUP).alias("event_name"),
            F.col("signup_date").alias("event_date"),
        )
    )
    per_order = orders.select(
        F.col("o_custkey").cast("bigint").alias("user_id"),
        order_event_name(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("event_name"),
        F.col("o_orderdate").alias("event_date"),
    )
    return signups.unionByName(per_order)


def plan_of(orderkey: Column) -> Column:
    return F.when(orderkey % PLAN_MOD < PLAN_ANNUAL_BELOW, F.lit(K.ANNUAL_PLAN)).otherwise(F.lit("monthly"))


def price_of(plan: Column) -> Column:
    """Plan price from the fixed price list (a CASE expression, no lookup join)."""
    expr = None
    for name, price in K.PLAN_PRICES.items():
        expr = F.when(plan == name, F.lit(price)) if expr is None else expr.when(plan == name, F.lit(price))
    return expr


def derive_subscriptions(orders: DataFrame) -> DataFrame:
    plan = plan_of(F.col("o_orderkey"))
    return (
        orders.where((F.col("o_orderpriority") == PRIORITY_SUBSCRIBED) & (F.col("o_orderstatus") == STATUS_FULFILLED))
        .select(
            F.col("o_custkey").cast("bigint").alias("user_id"),
            F.col("o_orderdate").alias("subscribed_date"),
            plan.alias("plan"),
            price_of(plan).alias("price_usd"),
        )
    )


def build_model(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> Model:
    return Model(derive_users(customer, orders, nation), derive_events(customer, orders), derive_subscriptions(orders))


def load_model(spark: SparkSession, base_dir: str) -> Model:
    return build_model(
        read_table(spark, base_dir, "customer"),
        read_table(spark, base_dir, "orders"),
        read_table(spark, base_dir, "nation"),
    )


def register_model_views(spark: SparkSession, model: Model, prefix: str = "m_") -> None:
    """Temp views ``m_users``, ``m_events``, ``m_subscriptions`` for SQL users."""
    model.users.createOrReplaceTempView(f"{prefix}users")
    model.events.createOrReplaceTempView(f"{prefix}events")
    model.subscriptions.createOrReplaceTempView(f"{prefix}subscriptions")


def raw_event_log(events_table: DataFrame) -> DataFrame:
    """The stored click-stream table seen as an event log (user_id, event_name, event_date, event_id)."""
    return events_table.select(
        "user_id",
        F.col("event_type").alias("event_name"),
        F.col("ts").alias("event_date"),
        "event_id",
    )
