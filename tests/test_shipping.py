"""Workers that do not have the package on their path get it from the session."""

import os
import subprocess
import sys

from quillflow.sources.shipping import packed

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from quillflow.functions.html import parsed
from quillflow.sources.shipping import ship
df = spark.createDataFrame([(1, "<title>t</title>")], "page_id int, html string")
ship(spark), ship(spark)
print("TITLE", parsed(df, "page_id").first().title)
"""


def test_workers_elsewhere(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "TITLE t" in done.stdout, done.stderr[-2000:]


def test_packing_is_the_same_each_time():
    assert packed() == packed()
