"""Python jobs run from any working directory: workers get the package from the session."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from talentmill.plans.queries import QUERIES
print("ROWS", QUERIES["hash_embed"](spark, {data!r}).count() > 0, QUERIES["cosine_topk"](spark, {data!r}).count() > 0)
"""


def test_python_jobs_from_a_foreign_folder(tmp_path, small_dir):
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    code = JOB.format(root=ROOT, data=small_dir, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS True True" in done.stdout, done.stderr[-2000:]


def test_queries_without_the_training_data_packages():
    """Where an import of the optional operators fails, the other queries are still there."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["public_tokenizers"] = None
from __spark_entry__ import oracle_sql, queries
print("QUERIES", len(queries()), len(oracle_sql()), any(q[:2] == "op" and q[2].isdigit() for q in queries()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    from talentmill.plans.queries import QUERIES
    assert f"QUERIES {len(QUERIES)} {len(QUERIES)} False" in done.stdout, done.stderr[-2000:]
