"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 39


def test_without_the_corpus_operators(tmp_path):
    """The entry imports without gleaner.llm and corpus_pipeline."""
    import shutil

    shutil.copytree(ROOT / "gleaner", tmp_path / "gleaner", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, extra = out.stdout.split()
    assert int(n) >= 39 and extra == "False"
