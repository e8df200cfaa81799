"""The flagship query on an ordinary driver, in a JVM of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__
print("ROWS", sorted((r.rule_id, r.pages) for r in __spark_entry__.entry(spark).collect()))
"""


def test_entry_within_one_gigabyte():
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM], capture_output=True, text=True, timeout=400, cwd=ROOT, env=env)
    assert "ROWS [('navigation/link-descriptive-text', 6), ('navigation/skip-link', 50), ('semantics/landmark-main', 50)]" in done.stdout, done.stderr[-2000:]
