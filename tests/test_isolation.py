"""The address engine stands without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROBE = """
import __spark_entry__ as e
names = e.queries()
assert len(names) >= 63 and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names
assert set(e.oracle_sql()) <= set(names)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert names["quality_report"](spark, "/root/testdata/sf0.001").count() >= 1
"""


def test_without_llm(tmp_path):
    """With llm and its tests deleted but corpus_pipeline.py still there, everything else works."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert not (tmp_path / "repo/dakspark/llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
