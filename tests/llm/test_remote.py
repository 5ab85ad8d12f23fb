"""Queries from a folder outside of the repository: tasks get along without a copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})  # of this process alone; Spark's workers don't have it
from ablatrix.session import local_session
spark = local_session(4)
spark.sparkContext.setLogLevel("ERROR")

def found(_):
    import importlib.util
    return importlib.util.find_spec("ablatrix") is not None

assert not spark.sparkContext.parallelize([0], 1).map(found).first()
from ablatrix.llm.catalog import CATALOG
for name in sys.argv[2:]:
    print(name, CATALOG[name](spark, sys.argv[1]).count())
"""


def test_workers_need_no_package(sf_dir, tmp_path):
    names = [
        "op1_toxicity", "op2_near_dedup", "op3_quality_classifier", "op4_context_weighting", "op10_decontamination",
        "op11_license_scan", "op12_merkle_manifest", "op13_hard_negatives",
    ]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, sf_dir, *names], cwd=tmp_path, capture_output=True, text=True, timeout=600, env=env)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split()) == 2 * len(names)
