"""The driver contract, from a process that starts in another folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
assert entry.entry(spark).count() > 0
queries = entry.queries()
assert set(entry.oracle_sql()) <= set(queries)
for name in ("x1_symbol_facts", "p12_strip_comments", "g1_classify"):
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0
print("done")
"""


def test_python_workers_do_not_need_the_package(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
