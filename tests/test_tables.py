"""Kept tables in a plain process, whose configuration names no shared folder."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from quarry.tables import kept, shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert kept(spark.range(5), "t").count() == 5 and shared_dir(spark) == shared_dir(spark.newSession())
print("kept")
"""


def test_without_a_shared_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    made = subprocess.run([sys.executable, "-c", CODE], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root), "TMPDIR": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert made.stdout.strip().endswith("kept"), made.stderr[-2000:]
