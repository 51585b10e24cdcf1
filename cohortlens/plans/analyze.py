"""The analyze run: materialise the model once, then run every analysis.

1. size scans and shuffles by the stored size of the input;
2. derive users / events / subscriptions from the stored tables and write
   them under the output folder; every later job reads these files, so a
   lost executor costs a file re-read;
3. funnel, cohort and revenue tables as CSV; the A/B text report; the
   dashboard JSON payload; the layouts of the three relations.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import experiment, funnel, retention, revenue, summary
from ..sources import sinks
from ..sources.model import Model, load_model
from ..session import input_bytes, size_session
from ..sources.tables import read_model_table, table_path
from .catalog import SAVED_SQL


def stored_model(spark: SparkSession, model_dir: str) -> Model:
    return Model(
        read_model_table(spark, model_dir, "users"),
        read_model_table(spark, model_dir, "events"),
        read_model_table(spark, model_dir, "subscriptions"),
    )


def analyze(spark: SparkSession, data_dir: str, out_dir: str) -> dict[str, str]:
    """Run the whole analysis; returns the written paths by name."""
    size_session(spark, input_bytes(spark, [table_path(data_dir, t) for t in ("customer", "orders")]))
    paths = {
        "model": f"{out_dir}/model",
        "funnel_csv": f"{out_dir}/output_funnel",
        "cohort_csv": f"{out_dir}/output_cohort",
        "revenue_csv": f"{out_dir}/output_revenue",
        "ab_text": f"{out_dir}/ab_test_result",
        "payload_json": f"{out_dir}/data_json",
        "event_layout": f"{out_dir}/events_by_month",
        "user_layout": f"{out_dir}/users_by_channel",
        "subscription_layout": f"{out_dir}/subscriptions_by_user",
    }
    sinks.write_model(load_model(spark, data_dir), paths["model"])
    m = stored_model(spark, paths["model"])
    sinks.export_csv(funnel.funnel_by_channel(m.users, m.events), paths["funnel_csv"])
    sinks.export_csv(retention.cohort_retention(m.users, m.events), paths["cohort_csv"])
    sinks.export_csv(revenue.revenue_by_channel(m.users, m.subscriptions), paths["revenue_csv"])
    sinks.write_text(experiment.ab_summary_text(m.users, m.events), "summary", paths["ab_text"])
    sinks.write_text(summary.dashboard_payload(m, SAVED_SQL), "payload", paths["payload_json"])
    sinks.write_event_layout(m.events, paths["event_layout"])
    sinks.write_user_layout(m.users, paths["user_layout"])
    sinks.write_subscription_layout(m.subscriptions, paths["subscription_layout"])
    return paths
