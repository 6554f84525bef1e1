"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parent.parent


def test_imports_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["trade_date", "gross", "turnover", "r", "nav", "drawdown"]
    rows = df.collect()
    assert len(rows) > 100 and rows[0] is not None and max(r["drawdown"] for r in rows) <= 0
