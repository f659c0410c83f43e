"""The entry module with and without the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

from workload import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXT = (("trailgrid/llm", "tests/llm", "corpus_pipeline.py"), ("trailgrid/llm", "tests/llm"))


@pytest.mark.parametrize("gone", TEXT)
def test_entry_imports_without_the_text_operators(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(folder, n), ROOT) in gone
    ])
    told = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert told.returncode == 0, told.stderr
    assert told.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE))]
