"""Python-worker code must run when the package is only on the driver's path."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
print("ROWS", E.entry(spark).count(), E.queries()["page_text_exact"](spark, "/root/testdata/sf0.001").count())
"""


def test_worker_functions_ship_by_value():
    cwd = tempfile.mkdtemp(prefix="finch-cwd-")        # a fresh empty folder, left in place
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    line = [l for l in out.stdout.splitlines() if l.startswith("ROWS")]
    assert line, out.stderr[-2000:]
    _, n_entry, n_pages = line[0].split()
    assert int(n_entry) > 0 and int(n_pages) > 0
