"""Folders, time stamps and schemas that the tests share."""

from datetime import datetime

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

USERS_DDL = (
    "user_id BIGINT, signup_date TIMESTAMP_NTZ, channel STRING, platform STRING, country STRING, "
    "experiment_group STRING"
)
EVENTS_DDL = "user_id BIGINT, event_name STRING, event_date TIMESTAMP_NTZ"
SUBS_DDL = "user_id BIGINT, subscribed_date TIMESTAMP_NTZ, plan STRING, price_usd DOUBLE"


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)
