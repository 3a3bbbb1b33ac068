"""The library and its entry without the operators for training text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
assert e.queries() and not [n for n in e.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"], sorted(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
from quillgauge.session import local_session
spark = local_session("2", "apart")
for name in ("distinctness", "token_budget", "mean_pool"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_training_text(tmp_path, pipeline):
    for name in ("quillgauge", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
