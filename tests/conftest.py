import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortlens.session import build_session  # noqa: E402
from model_rows import EVENTS_DDL, SUBS_DDL, USERS_DDL  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = {"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    s = build_session("local[4]", app_name="cohortlens-tests", shuffle_partitions=4, extra_conf=shared)
    yield s
    s.stop()


@pytest.fixture
def make(spark):
    """make(kind, rows) -> DataFrame with the fixed schema of users / events / subscriptions."""
    ddl = {"users": USERS_DDL, "events": EVENTS_DDL, "subscriptions": SUBS_DDL}

    def _make(kind, rows):
        return spark.createDataFrame(rows, ddl[kind])

    return _make
