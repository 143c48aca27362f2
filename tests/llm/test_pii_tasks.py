"""op8 in its tasks: one thread for numpy, and texts spread over all cores."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tessera.llm import pii

THREADS = """
import ctypes, types
import numpy
from tessera.llm.pii import _find
list(_find([], types.SimpleNamespace(value=None), 0.8))
path = next(x.split(None, 5)[5].strip() for x in open("/proc/self/maps") if "openblas" in x)
lib = ctypes.CDLL(path)
print(next(getattr(lib, n)() for n in ("scipy_openblas_get_num_threads64_", "scipy_openblas_get_num_threads", "openblas_get_num_threads64_", "openblas_get_num_threads") if hasattr(lib, n)))
"""


def test_a_task_has_one_thread():
    env = os.environ | {"OMP_NUM_THREADS": "4", "OPENBLAS_NUM_THREADS": "4", "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    assert subprocess.run([sys.executable, "-c", THREADS], env=env, capture_output=True, text=True, check=True).stdout.strip() == "1"


def test_one_file_is_spread_over_tasks(spark):
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail me at a"), F.col("id"), F.lit("@example.com")).alias("text"))
    found = pii.find_pii(docs)
    assert found.rdd.getNumPartitions() >= 4 and found.where("n_email = 1").count() == 400
