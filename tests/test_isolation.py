import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_training_data_operators(tmp_path, pipeline):
    skipped = {"llm", ".git", "__pycache__"} | (set() if pipeline else {"corpus_pipeline.py"})
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda _, names: [n for n in names if n in skipped])
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
