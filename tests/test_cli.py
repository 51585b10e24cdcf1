"""The job entry point, run as its own process (it owns and stops its session)."""

import os
import subprocess
import sys

from model_rows import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(*args):
    return subprocess.run([sys.executable, "-m", "cohortlens", *args], cwd=ROOT, capture_output=True,
                          text=True, timeout=600)


def test_quality_command_passes_on_clean_tables():
    out = run("quality", SF001)
    lines = [l for l in out.stdout.splitlines() if l.startswith(" [")]
    assert out.returncode == 0, out.stderr[-2000:]
    assert len(lines) == 5 and all(l.startswith(" [PASSED]") for l in lines)


def test_quality_command_fails_on_null_signup():
    out = run("quality", "/root/testdata/sf0.1")
    assert out.returncode == 1
    assert " [FAILED] Mandatory Fields Non-Null Constraint: 1 null values in mandatory fields!" in out.stdout
