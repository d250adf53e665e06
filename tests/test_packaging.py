"""Task-side Python (pandas UDFs) must not need the package installed on workers."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
rows = e.queries()["test_table_feed"](spark, "/root/testdata/sf0.001").select("p_value_display").collect()
assert any(r.p_value_display is not None for r in rows)
print("OK")
"""


def test_udfs_run_from_foreign_working_directory():
    cwd = tempfile.mkdtemp(prefix="clickpath-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK" in out.stdout
