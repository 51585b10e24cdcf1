"""Exploration: ad-hoc SQL, plans, user lookups, journeys, search."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import stored
from . import pages

# strings and names in quotes, comments, semicolons, single characters
_PIECES = re.compile(r"""(?P<skip>--[^\n]*|/\*.*?\*/|;)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|.)""", re.S)


def query_only(sql_text: str) -> str:
    """Wrap a statement so that only a query parses.

    ``spark.sql`` executes commands eagerly (a DROP acts before any action);
    inside ``SELECT * FROM ( ... )`` the parser refuses DDL/DML, SHOW and a
    closing-parenthesis injection, while SELECT, WITH, VALUES, inner ORDER BY,
    trailing comments and bound parameters keep working. Semicolons at the
    end go, also with comments behind them.
    """
    end = 0
    for piece in _PIECES.finditer(sql_text):
        if piece.lastgroup == "text" and not piece[0].isspace():
            end = piece.end()
    return f"SELECT * FROM (\n{sql_text[:end].strip()}\n)"


def adhoc_sql(spark: SparkSession, sql_text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """Run one read-only Spark SQL query with optional named parameters (``:name``)."""
    return spark.sql(query_only(sql_text), args=dict(args) if args else None)


def adhoc_result(spark: SparkSession, sql_text: str, args: Mapping[str, Any] | None = None, path: str | None = None) -> dict:
    """Result shape of the query endpoint: status, elapsed_ms, count, columns and every row.

    The whole result is written as Parquet (to ``path``, or a folder of the shared one): ``rows`` is a DataFrame of it, and ``result``
    a ``pages.Result`` whose pages are read without the others.
    """
    start = time.perf_counter()
    try:
        found = pages.store(adhoc_sql(spark, sql_text, args), path)
        return {
            "status": "success",
            "columns": found.schema.names,
            "rows": spark.read.schema(found.schema).parquet(found.path),
            "result": found,
            "path": found.path,
            "count": found.count,
            "elapsed_ms": round((time.perf_counter() - start) * 1000, 2),
        }
    except Exception as exc:  # reported to the caller, as the endpoint does
        return {"status": "error", "error_message": str(exc)}


def explain_plan(spark: SparkSession, sql_text: str, mode: str = "FORMATTED") -> DataFrame:
    """One row, column ``plan``: Spark's plan for the query.

    A query that does not analyze comes back as plan text carrying the
    analyzer's message (Spark's own EXPLAIN drops the message).
    """
    try:
        spark.sql(query_only(sql_text))  # parse + analyze only; nothing runs
    except Exception as exc:
        message = f"Error occurred during query planning: {exc}"
        return spark.createDataFrame([(message,)], "plan STRING")
    return spark.sql(f"EXPLAIN {mode} {query_only(sql_text)}")


# Fixed value: the whitespace stripped around an id (ASCII whitespace, as str.strip()).
ID_WHITESPACE = " \t\n\r\x0b\x0c"


def normalise_user_id(text: Column) -> Column:
    """trim whitespace, lower, drop 'user_', strip leading zeros, empty -> '1', then to bigint (NULL if not a number)."""
    stripped = F.trim(text, F.lit(ID_WHITESPACE))
    cleaned = F.ltrim(F.replace(F.lower(stripped), F.lit("user_"), F.lit("")), F.lit("0"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("1")).try_cast("bigint")


def is_user(user_id: int | str) -> Column:
    """Rows of a user given by number, or by text as a person types it (" user_0042 ")."""
    wanted = normalise_user_id(F.lit(user_id)) if isinstance(user_id, str) else F.lit(user_id)
    return F.col("user_id") == wanted


def user_profile(users: DataFrame, user_id: int | str) -> DataFrame:
    return users.where(is_user(user_id)).select(
        "user_id", "signup_date", "channel", "platform", "country", "experiment_group"
    )


def event_label(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit("_"), F.lit(" ")))


def user_timeline(events: DataFrame, user_id: int | str, tie_break: Sequence[str] = ("event_name",)) -> DataFrame:
    """One user's events in time order with display labels (a distributed sort)."""
    cols = ["user_id", "event_name", "event_date", *[c for c in tie_break if c != "event_name"]]
    return (
        events.where(is_user(user_id))
        .select(*cols, event_label(F.col("event_name")).alias("event_label"))
        .orderBy("event_date", *tie_break)
    )


def first_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """(user_id, s): the earliest subscription of each user, then by plan and price."""
    return subscriptions.groupBy("user_id").agg(F.min(F.struct("subscribed_date", "plan", "price_usd")).alias("s"))


def user_subscription(users: DataFrame, subscriptions: DataFrame, user_id: int | str) -> DataFrame:
    """First subscription of a user (earliest, then plan) with its label, or 'Free Tier'."""
    first = first_subscriptions(subscriptions.where(is_user(user_id)))
    label = F.concat(F.col("s.plan"), F.lit(" ($"), F.col("s.price_usd").cast("string"), F.lit(")"))
    return (
        users.where(is_user(user_id))
        .select("user_id")
        .join(first, "user_id", "left")
        .select(
            "user_id",
            F.col("s.subscribed_date").alias("subscribed_date"),
            F.col("s.plan").alias("plan"),
            F.col("s.price_usd").alias("price_usd"),
            F.coalesce(label, F.lit(K.FREE_TIER_LABEL)).alias("plan_label"),
        )
    )


def user_journeys(events: DataFrame, order_key: str = "event_id") -> DataFrame:
    """One bounded summary row per user of its whole event history.

    Every aggregate is partial-aggregatable (count, min/max, min_by/max_by,
    one distinct count), so a user owning a large share of the log costs one
    partial row per map task and no per-user list is ever built. The ordered
    event list itself is ``user_timeline`` (a distributed sort).
    """
    order = F.struct("event_date", order_key)
    return events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.countDistinct("event_name").alias("n_event_types"),
        F.min("event_date").alias("first_event_at"),
        F.max("event_date").alias("last_event_at"),
        F.min_by("event_name", order).alias("first_event"),
        F.max_by("event_name", order).alias("last_event"),
    )


def user_journeys_events(users: DataFrame, events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The journeys of all users, one row per (user, event): profile, event with label, first plan.

    Flat and range-sorted by (user_id, event_date, event_name), so a user with very many events is spread
    over several tasks and no list is built. Users without events have one row with NULL event columns. The users' side is
    stored while the plan is built.
    """
    first = first_subscriptions(subscriptions.where(F.col("user_id").isNotNull()))
    # copies of a users row collapse to one before the join with the log
    profile = users.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        *(F.min(c).alias(c) for c in ("signup_date", "channel", "platform", "country", "experiment_group"))
    )
    label = F.concat(F.col("s.plan"), F.lit(" ($"), F.col("s.price_usd").cast("string"), F.lit(")"))
    people = profile.join(first, "user_id", "left")
    people = people.select(
        *profile.columns,
        F.col("s.subscribed_date").alias("subscribed_date"),
        F.col("s.plan").alias("plan"),
        F.col("s.price_usd").alias("price_usd"),
        F.coalesce(label, F.lit(K.FREE_TIER_LABEL)).alias("plan_label"),
    )
    # stored, so that both sides of the join are shuffled for it alone: AQE then splits the log of one user
    people = stored(people, "people")
    log = events.select("user_id", "event_name", "event_date", event_label(F.col("event_name")).alias("event_label"))
    silent = people.join(events.select("user_id").distinct(), "user_id", "left_anti")
    found = log.join(people, "user_id").unionByName(silent, allowMissingColumns=True)
    return found.select(*people.columns, "event_name", "event_date", "event_label").orderBy("user_id", "event_date", "event_name")


def result_search(df: DataFrame, term: str) -> DataFrame:
    """Rows whose text (all columns joined by spaces) contains ``term``, case-insensitive."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    return df.where(F.contains(text, F.lit(term.lower())))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each named table, stacked with unionByName."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
