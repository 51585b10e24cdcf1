"""Job entry point (``python -m cohortlens``).

    python -m cohortlens analyze DATA_DIR OUT_DIR   # all analyses, CSV / text / JSON / layout
    python -m cohortlens quality DATA_DIR           # the five checks; exit code 1 on failure

The master and cluster settings come from the launcher; a local master is
used only when none is configured.
"""

from __future__ import annotations

import argparse
import sys

from .plans.analyze import analyze
from .session import build_session
from .sources.model import load_model
from .operators.quality import quality_report


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cohortlens")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze", help="run every analysis and write the outputs")
    a.add_argument("data_dir")
    a.add_argument("out_dir")
    q = sub.add_parser("quality", help="run the data-quality checks")
    q.add_argument("data_dir")
    args = parser.parse_args(argv)

    from pyspark import SparkConf

    master = None if SparkConf().contains("spark.master") else "local[*]"
    spark = build_session(master, app_name=f"cohortlens-{args.command}")
    try:
        if args.command == "analyze":
            for name, path in analyze(spark, args.data_dir, args.out_dir).items():
                print(f"{name}: {path}")
            return 0
        report = quality_report(*load_model(spark, args.data_dir)).orderBy("check_order")
        ok = True
        for row in report.collect():  # five rows, one per check
            print(f" [{'PASSED' if row.passed else 'FAILED'}] {row.check_name}: {row.details}")
            ok = ok and bool(row.passed)
        return 0 if ok else 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
