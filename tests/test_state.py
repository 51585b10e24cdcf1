"""The summary from kept state: equal to the one from all rows, old files unread."""

import glob
import json
import os
from datetime import timedelta

import pytest

from cohortlens.operators import facts, state, summary
from cohortlens.sources.model import Model
from model_rows import EVENTS_DDL, SUBS_DDL, USERS_DDL
from test_skew import fixture_rows

DDL = dict(zip(state.RELATIONS, (USERS_DDL, EVENTS_DDL, SUBS_DDL)))


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}"


def append(spark, base, **rows):
    for name, own in rows.items():
        spark.createDataFrame(own, DDL[name]).coalesce(1).write.mode("append").parquet(f"{base}/model/{name}")


def whole(spark, base):
    return Model(*(spark.read.schema(DDL[n]).parquet(f"{base}/model/{n}") for n in state.RELATIONS))


def same(kept, model):
    """Every field of every list of the payload, and the KPI row."""
    found = []
    for a in (kept.analyses(), summary.Analyses(model)):
        rows = summary.payload_long(None, a).collect()
        found.append((sorted((tuple(r) for r in rows), key=repr), summary.kpi_summary(None, a).collect()))
    assert found[0] == found[1]


def spoil(base):
    """Overwrite all files with zeros, of the same size and time: whoever reads one of them fails."""
    for f in glob.glob(f"{base[7:]}/model/*/*.parquet"):
        st = os.stat(f)
        with open(f, "r+b") as out:
            out.write(b"\0" * st.st_size)
        os.utime(f, ns=(st.st_atime_ns, st.st_mtime_ns))
        crc = f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc"
        if os.path.exists(crc):
            os.remove(crc)


def in_time(users, events):
    """Signups before every event, so that no user breaks the rule."""
    return [(u[0], u[1] - timedelta(days=400), *u[2:]) for u in users], events


def test_state_and_delta_equal_everything(spark, base):
    users, events, subs = fixture_rows()
    kept = state.ModelState(spark, f"{base}/state")
    append(spark, base, users=users[:150], events=events[:2000], subscriptions=subs[:4])
    assert len(kept.update(f"{base}/model")) == 3
    same(kept, whole(spark, base))
    # repeated keys, a hot user's events, later months, users who break the rule only now
    append(spark, base, users=users[150:], events=events[2000:] + [(1, "app_open", e[2] + timedelta(days=3000)) for e in events[:5]], subscriptions=subs[4:])
    read = kept.update(f"{base}/model")
    assert sorted(f.relation for f in read) == ["events", "subscriptions", "users"]
    same(kept, whole(spark, base))
    append(spark, base, events=events[:50])
    assert [f.relation for f in kept.update(f"{base}/model")] == ["events"]
    same(kept, whole(spark, base))
    assert kept.update(f"{base}/model") == []


def test_old_files_are_not_read(spark, base, tmp_path):
    users, events = in_time(*fixture_rows()[:2])
    subs = fixture_rows()[2]
    kept = state.ModelState(spark, f"{base}/state")
    append(spark, base, users=users, events=events[:2500], subscriptions=subs)
    kept.update(f"{base}/model")
    spoil(base)
    append(spark, base, events=events[2500:])
    assert [f.relation for f in kept.update(f"{base}/model")] == ["events"]
    model = Model(*(spark.createDataFrame(r, DDL[n]) for n, r in zip(state.RELATIONS, (users, events, subs))))
    same(kept, model)


def test_changed_files_start_anew(spark, base):
    users, events, subs = fixture_rows()
    kept = state.ModelState(spark, f"{base}/state")
    append(spark, base, users=users, events=events, subscriptions=subs)
    kept.update(f"{base}/model")
    spark.createDataFrame(events[:700], EVENTS_DDL).write.mode("overwrite").parquet(f"{base}/model/events")
    assert {f.relation for f in kept.update(f"{base}/model")} == {"users", "events", "subscriptions"}
    same(kept, whole(spark, base))


def test_versions_of_the_state(spark, base, monkeypatch):
    """An update that fails leaves the state, and old versions can go."""
    users, events, subs = fixture_rows()
    kept = state.ModelState(spark, f"{base}/state")
    with pytest.raises(LookupError):
        kept.analyses()
    append(spark, base, users=users, events=events[:1000], subscriptions=subs)
    kept.update(f"{base}/model")
    before, known = kept.kpi_summary().collect(), kept.covered()
    append(spark, base, events=events[1000:])
    with monkeypatch.context() as m:
        m.setattr(state.ModelState, "_early", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.update(f"{base}/model")
    assert kept.covered() == known and kept.kpi_summary().collect() == before
    kept.update(f"{base}/model")
    kept.expire(keep=1)
    same(kept, whole(spark, base))


def test_payload_from_state(spark, base):
    users, events, subs = fixture_rows()
    append(spark, base, users=users, events=events, subscriptions=subs)
    kept = state.ModelState(spark, f"{base}/state")
    kept.update(f"{base}/model")
    mine = summary.dashboard_payload(None, {"q": "SELECT 1"}, analyses=kept.analyses()).first().payload
    assert json.loads(mine) == json.loads(summary.dashboard_payload(whole(spark, base), {"q": "SELECT 1"}).first().payload)


def test_empty_model(spark, base):
    append(spark, base, users=[], events=[], subscriptions=[])
    kept = state.ModelState(spark, f"{base}/state")
    kept.update(f"{base}/model")
    same(kept, whole(spark, base))


def test_facts_have_no_window(spark):
    users, events, subs = fixture_rows()
    model = Model(*(spark.createDataFrame(r, DDL[n]) for n, r in zip(state.RELATIONS, (users, events, subs))))
    seen = []
    original = facts.stored
    try:
        facts.stored = lambda df, label: seen.append(df) or original(df, label)
        facts.summary_cells(facts.user_facts(model))
    finally:
        facts.stored = original
    assert len(seen) == 2 and all("Window" not in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)
