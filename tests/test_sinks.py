"""Writers and the analyze run."""

import csv
import glob
import io
import os
import tempfile

from model_rows import SF001
from cohortlens.plans.analyze import analyze, stored_model
from cohortlens.sources import sinks


def scratch():
    return tempfile.mkdtemp(prefix="cohortlens-test-", dir="/tmp")


def in_order(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


ROWS = [("a", 1, None), ('say "hi"', 2, 1.5), ("x,y", 3, -0.25), (None, None, None), ("two\nlines", 4, 1e10), ("", 5, 0.0)]


def test_csv_parts_are_one_file(spark):
    """Two parts and the header, byte for byte."""
    out = scratch()
    df = spark.createDataFrame(ROWS, "s STRING, n INT, `x,1` DOUBLE")
    assert df.rdd.getNumPartitions() > 1
    sinks.export_csv(df, f"{out}/c")
    sinks.export_csv_quoted(df, f"{out}/q")
    assert len(glob.glob(f"{out}/c/part-*")) > 2
    assert in_order(f"{out}/c") == (
        's,n,"x,1"\na,1,\n"say ""hi""",2,1.5\n"x,y",3,-0.25\n,,\n"two\nlines",4,1.0E10\n,5,0.0\n'
    )
    assert in_order(f"{out}/q") == (
        's,n,"x,1"\n"a","1",""\n"say ""hi""","2","1.5"\n"x,y","3","-0.25"\n"","",""\n"two\nlines","4","1.0E10"\n"","5","0.0"\n'
    )
    read = list(csv.reader(io.StringIO(in_order(f"{out}/q"))))
    assert [r[0] for r in read[1:]] == [r[0] or "" for r in ROWS]


def test_csv_of_nothing_is_its_header(spark):
    out = scratch()
    sinks.export_csv(spark.createDataFrame([], "s STRING, n INT"), f"{out}/c")
    assert in_order(f"{out}/c") == "s,n\n"


def test_analyze_writes_everything(spark):
    out = scratch()
    paths = analyze(spark, SF001, out)
    header = in_order(paths["funnel_csv"]).splitlines()[0]
    assert header.split(",") == [
        "channel", "signups", "onboarded", "pct_onboarded", "edited", "pct_onboarded_to_edit", "trialed",
        "pct_edit_to_trial", "subscribed", "pct_trial_to_paid", "overall_conversion_pct"]
    report = "".join(open(p).read() for p in sorted(glob.glob(f"{paths['ab_text']}/part-*")))
    assert report.startswith("Control activation:") and "Cohen's h:" in report
    m = stored_model(spark, paths["model"])
    assert m.users.count() == 150
    months = [os.path.basename(p) for p in glob.glob(f"{paths['event_layout']}/event_month=*")]
    assert months and all(p.startswith("event_month=") for p in months)
    laid = spark.read.parquet(paths["event_layout"])
    assert laid.count() == m.events.count()
    payload = spark.read.text(paths["payload_json"]).count()
    assert payload == 1


def test_sizing_conf():
    from cohortlens.session import sizing_conf
    small = sizing_conf(10 * 1024 ** 2)
    assert small["spark.sql.shuffle.partitions"] == "8"
    big = sizing_conf(100 * 1024 ** 4)
    assert big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == str(100 * 1024)
    mid = sizing_conf(2 * 1024 ** 4)
    assert mid["spark.sql.shuffle.partitions"] == "2048"
    assert big["spark.sql.files.maxPartitionBytes"] == str(1 << 30) + "b"


def test_event_layout_files_hold_disjoint_user_ranges(spark):
    import pyarrow.parquet as pq
    from cohortlens.sources.model import load_model
    out = scratch()
    sinks.write_event_layout(load_model(spark, SF001).events, f"{out}/layout", num_files=16)
    months = glob.glob(f"{out}/layout/event_month=*")
    assert len(months) > 1
    for month in months:
        ranges = []
        for f in glob.glob(f"{month}/*.parquet"):
            col = pq.read_table(f, columns=["user_id"]).column("user_id").to_pylist()
            assert col == sorted(col)  # sorted by user inside the file
            ranges.append((min(col), max(col)))
        ranges.sort()
        for (lo1, hi1), (lo2, hi2) in zip(ranges, ranges[1:]):
            assert hi1 <= lo2  # contiguous user ranges: min/max statistics prune point lookups
