"""Plan shape guards (no execution): the properties the scale design relies on."""

import contextlib
import io
import re

import pytest

from model_rows import SF001
from cohortlens.plans import catalog, registry
from cohortlens.plans.registry import QUERIES
from cohortlens.sources.model import load_model


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan(b(spark, SF001)) for k, b in QUERIES.items()}


def test_no_expand_cartesian_or_python(plans):
    for key, text in plans.items():
        assert not re.search(r"\(\d+\) Expand", text), key
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, key
        assert "EvalPython" not in text and "FlatMapGroupsInPandas" not in text, key


def test_lookups_push_filters_to_scans(plans):
    assert "EqualTo(c_custkey,8)" in plans["user_profile"]
    assert "EqualTo(o_custkey,8)" in plans["user_profile"]
    assert "EqualTo(user_id,8)" in plans["user_timeline"]
    assert "EqualTo(c_mktsegment,BUILDING)" in plans["funnel_for_channel"]


def test_scans_read_only_needed_columns(plans):
    m = re.search(r"ReadSchema: (struct<[^\n]*>)", plans["event_counts"])
    assert m.group(1) == "struct<event_type:string>"


def test_top_k_is_not_a_full_sort(plans):
    assert "TakeOrderedAndProject" in plans["at_risk_users"]


def test_summary_is_one_plan_without_subqueries(plans):
    assert "Subquery" not in plans["kpi_summary"]


def test_summary_reads_the_stored_sums_only(plans):
    for key in ("kpi_summary", "dashboard_payload", "payload_long"):
        assert "orders.parquet" not in plans[key], key


def executed_scans(df, table: str) -> int:
    """Scans of a table in the plan that ran (reused exchanges have none)."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len([x for x in final.splitlines() if "FileScan" in x and f"/{table}.parquet" in x])


def test_facts_and_profile_read_the_orders_at_most_four_times(spark, monkeypatch):
    from cohortlens.operators import facts, quality
    for module, build in ((facts, lambda m: facts.user_facts(m)), (quality, lambda m: quality.user_profile(*m))):
        seen = []
        monkeypatch.setattr(module, "stored", lambda df, label: seen.append(df) or df)
        build(load_model(spark, SF001))
        assert executed_scans(seen[0], "orders") <= 4


def test_saved_statements_need_no_expand(plans):
    assert set(catalog.SAVED_SQL) == {k.removeprefix("saved_") for k in plans if k.startswith("saved_")}


def test_unused_country_is_not_read(plans):
    for key in ("churn_rollup", "revenue_by_channel", "funnel_by_channel"):
        assert "nation.parquet" not in plans[key], key


def test_a_second_call_sees_new_files(spark, tmp_path):
    import shutil
    for t in ("customer", "orders", "nation"):
        (tmp_path / f"{t}.parquet").mkdir()
        shutil.copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet" / "part-0.parquet")
    build = registry.QUERIES["table_counts"]
    before = {r.table_name: r.row_count for r in build(spark, str(tmp_path)).collect()}
    shutil.copy(f"{SF001}/orders.parquet", tmp_path / "orders.parquet" / "part-1.parquet")
    after = {r.table_name: r.row_count for r in build(spark, str(tmp_path)).collect()}
    signups = spark.read.parquet(f"{SF001}/orders.parquet").select("o_custkey").distinct().count()
    assert after["events"] - signups == 2 * (before["events"] - signups)
    assert after["subscriptions"] == 2 * before["subscriptions"]
