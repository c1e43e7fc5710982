"""The driver contract holds with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("left_out", [(), ("answerflow/llm", "tests/llm"), ("answerflow/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports(tmp_path, left_out):
    copy = tmp_path / "repo"
    missing = {str(ROOT / p) for p in left_out}

    def ignore(folder, names):
        return [n for n in names if n in (".git", "__pycache__", ".pytest_cache") or os.path.join(folder, n) in missing]

    shutil.copytree(ROOT, copy, ignore=ignore)
    # Nothing of the subpackage is imported by the rest.
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr[-2000:]
    queries, oracles, pipeline = done.stdout.split()[-3:]
    whole = (ROOT / "answerflow/llm").exists() and (ROOT / "corpus_pipeline.py").exists()
    assert (pipeline == "True") == (whole and not left_out)
    from checks import ORACLES, QUERIES

    if "answerflow/llm" in left_out:
        assert (int(queries), int(oracles)) == (len(QUERIES), len(ORACLES))
