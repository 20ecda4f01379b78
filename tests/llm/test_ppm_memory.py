"""What training leaves in the driver's memory."""

import gc
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from treeloom.llm import ppm
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
held = lambda: next(int(x.split()[1]) // 1024 for x in open("/proc/self/status") if x.startswith("RssAnon"))
before = held()
model = ppm.fitted(docs)
print("MB", held() - before, len(ppm.sample(docs)))
"""


def test_training_gives_memory_back():
    """Training takes some 100 MB for a time, and 50 MB stayed for good."""
    gc.collect()
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, timeout=300, check=True).stdout
    kept, languages = map(int, out.split("MB ")[-1].split())
    assert kept < 35 and languages == 4
