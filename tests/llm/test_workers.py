"""Operators on workers that do not have this repository on their path."""

import os
import subprocess
import sys

from tests.conftest import SMALL

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
)
for name in sys.argv[2:]:
    print(name, entry.queries()[name](spark, {SMALL!r}).count())
"""


def test_models_travel_by_value(tmp_path):
    names = ["op1_sentencepiece", "op2_secret_scan", "op6_line_quality", "op9_toxicity", "op11_hilbert_negatives", "op12_fp_search"]
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_PYTHON")}
    import public_tokenizers

    env["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(public_tokenizers.__file__)))
    env["PYSPARK_PYTHON"] = sys.executable
    done = subprocess.run(
        [sys.executable, "-c", RUN, str(tmp_path / "shared"), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
