"""Executors have no copy of the library: everything must travel by value."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import importlib.util, sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
sys.path.remove({root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.range(1).mapInArrow(lambda batches: batches, "id long").collect()
def absent(batches):
    import importlib.util
    import pyarrow as pa
    assert importlib.util.find_spec("rastergrid") is None, "the test must run where workers cannot import the library"
    yield from batches
spark.range(1).mapInArrow(absent, "id long").collect()
for name in ("op4_lm_scores", "op5_language", "op12_collocations", "op13_resample", "pipeline"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0, name
    print("done", name)
"""


def test_queries_run_where_workers_cannot_import_the_library(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=sf)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=900)
    assert done.stdout.count("done") == 5, done.stderr[-3000:]
