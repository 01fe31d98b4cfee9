"""Executors have no copy of this package: workers are started in another folder and without a path to it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
from loopmill.llm.queries import QUERIES
for name in sys.argv[1:]:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_models_reach_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    names = ["op2_language", "op5_pii", "op6_ann", "op10_toxicity"]
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO)), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(counts) == set(names) and all(int(n) > 0 for n in counts.values())
