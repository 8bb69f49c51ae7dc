"""The queries where workers cannot import the package: models have to travel by value."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
queries = entry.queries()
for name in sorted(queries):
    if name.startswith("op") or name == "pipeline":
        print(name, queries[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_run_where_workers_cannot_import_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "PYSPARK", "SPARK_"))}
    (tmp_path / "empty").mkdir()
    code = CODE.format(root=ROOT, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "empty", env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 14 and all(int(n) > 0 for name, n in counts.items() if not name.startswith("op12"))
