"""The rest works without the training-data package, its tests and the pipeline that goes with it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 40, len(q); print(*q)"


@pytest.mark.parametrize("gone", [["corvine/llm", "tests/llm"], ["corvine/llm", "tests/llm", "corpus_pipeline.py"]])
def test_import_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and "op1" not in said.stdout and "pipeline" not in said.stdout, said.stderr
    found = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stdout[-800:]
