"""Writers: tables, layouts, CSV / JSON / text exports.

All writers are distributed Spark writes (one file per task, committed by
Spark's output committer). Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import snapshots
from .model import Model


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table: its next version (``snapshots``). A failed write leaves the old one, and a table can be replaced
    by a query on itself; ``snapshots.read`` reads it, ``snapshots.expire`` deletes versions."""
    snapshots.write(df, path)


def write_model(model: Model, base_dir: str) -> None:
    """Store users / events / subscriptions under ``base_dir``.

    The stored tables cut the lineage of the derivation: later jobs start from
    these files, so a lost executor only re-reads files instead of recomputing
    the derivation.
    """
    write_table(model.users, f"{base_dir}/users")
    write_table(model.events, f"{base_dir}/events")
    write_table(model.subscriptions, f"{base_dir}/subscriptions")


def write_event_layout(events: DataFrame, path: str, num_files: int | None = None) -> None:
    """Event log laid out for lookups by month, user, event and date.

    * directories per ``event_month`` (partition pruning on date ranges);
    * range partitioning on (event_month, user_id, event_date): each file holds
      a contiguous user range of one month, so Parquet min/max statistics on
      ``user_id`` skip the other files of a point lookup; the date in the
      range key lets the sampler split a user with very many events;
    * rows sorted by (user_id, event_date, event_name) inside each file.
    """
    n = num_files or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = events.withColumn("event_month", F.date_format("event_date", "yyyy-MM"))
    (
        laid.repartitionByRange(n, "event_month", "user_id", "event_date")
        .sortWithinPartitions("event_month", "user_id", "event_date", "event_name")
        .write.mode("overwrite")
        .partitionBy("event_month")
        .parquet(path)
    )


def write_user_layout(users: DataFrame, path: str, num_files: int | None = None) -> None:
    """Users laid out for lookups by channel, arm, signup month and user: directories per channel and arm, ranges of
    (signup month, user) inside, so that min/max statistics skip the other files."""
    n = num_files or int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = users.withColumn("signup_month", F.date_format("signup_date", "yyyy-MM"))
    keys = ["channel", "experiment_group", "signup_month", "user_id"]
    writer = laid.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite")
    writer.partitionBy("channel", "experiment_group").parquet(path)


def write_subscription_layout(subscriptions: DataFrame, path: str, num_files: int | None = None) -> None:
    """Subscriptions in ranges of (user, date): a user's rows lie in one or two files."""
    n = num_files or int(subscriptions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["user_id", "subscribed_date"]
    subscriptions.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def csv_lines(df: DataFrame, quote_all: bool = False) -> DataFrame:
    """One column, ``value``: the header, then a line a row in the order of ``df``.

    Values are quoted where they hold a comma, a quote or a line break, with ``quote_all`` all of them; quotes inside are
    doubled. NULL is empty (with ``quote_all`` an empty pair of quotes). Names in the header are quoted only where they must be.
    """

    def text(value: Column, always: bool) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return quoted if always else F.when(value.rlike('[",\r\n]'), quoted).otherwise(value)

    values = [text(F.coalesce(df[f"`{c}`"].cast("string"), F.lit("")), quote_all) for c in df.columns]
    names = F.concat_ws(",", *(text(F.lit(c), False) for c in df.columns))
    header = df.sparkSession.range(1, numPartitions=1).select(names.alias("value"))
    return header.unionByName(df.select(F.concat_ws(",", *values).alias("value")))


def export_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV in parts whose names are in order; the header is in the first alone, so the parts one after another are the file."""
    csv_lines(df, quote_all).write.mode("overwrite").text(path)


def export_csv_quoted(df: DataFrame, path: str) -> None:
    """CSV with every value quoted and the header as it is."""
    export_csv(df, path, quote_all=True)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """Write one string column as text lines (the JSON payload, the A/B report)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
