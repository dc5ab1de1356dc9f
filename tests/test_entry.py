"""The entry module without the optional operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.abspath(os.path.join(os.path.dirname(__file__), ".."))
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert 'risk_level_counts' in names and set(e.oracle_sql()) <= names
print(sorted(n for n in names if n.startswith('op') or n == 'pipeline'))
"""


@pytest.mark.parametrize("keep_pipeline", [True, False])
def test_entry_imports_without_the_operators(tmp_path, keep_pipeline):
    shutil.copytree(f"{ROOT}/mailsift", tmp_path / "mailsift",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if keep_pipeline and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {
        "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)
                                      if p and os.path.abspath(p) != ROOT)}
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "op1_" not in run.stdout and "'pipeline'" not in run.stdout
