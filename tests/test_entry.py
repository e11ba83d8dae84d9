"""The driver contract when parts of the repository are not there."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), *sorted(q))"


@pytest.mark.parametrize("gone", [("nightloom/llm", "tests/llm"), ("nightloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, gone):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *(Path(x).name for x in gone)))
    told = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=there, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    names = told.stdout.split()
    assert int(names[0]) > 100 and "transition_matrix" in names and "pipeline" not in names and not [x for x in names if x.startswith("op")]
