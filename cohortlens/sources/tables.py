"""Reading the stored tables.

Each table is one Parquet dataset. Reads are lazy; Catalyst prunes columns
and pushes filters into the Parquet scan, so callers select only what they
use and never ``*``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import snapshots

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Reference-shaped tables (when stored as Parquet by ``sinks.write_model``).
USERS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("signup_date", T.TimestampNTZType()),
    T.StructField("channel", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("experiment_group", T.StringType()),
])
EVENTS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("event_date", T.TimestampNTZType()),
])
SUBSCRIPTIONS_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("subscribed_date", T.TimestampNTZType()),
    T.StructField("plan", T.StringType()),
    T.StructField("price_usd", T.DoubleType()),
])
MODEL_SCHEMAS = {"users": USERS_SCHEMA, "events": EVENTS_SCHEMA, "subscriptions": SUBSCRIPTIONS_SCHEMA}


def table_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(base_dir, name))


def read_model_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read a stored users/events/subscriptions table (``sinks.write_model``) with its fixed schema."""
    found = snapshots.version(spark, f"{base_dir.rstrip('/')}/{name}")
    if found is None:
        raise LookupError(f"no {name} below {base_dir}")
    return spark.read.schema(MODEL_SCHEMAS[name]).parquet(found.data)
