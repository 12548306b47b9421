"""The rest of the library without the training-data subpackage, and without a library that only it needs."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["folders", "library"])
def test_entry_without_training_data_queries(tmp_path, missing):
    shutil.copytree(ROOT / "evidencelake", tmp_path / "evidencelake", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if missing == "folders" else [])))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    block = "import sys; sys.modules['tokenizers'] = None; " if missing == "library" else ""
    code = block + "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 130; print([n for n in q if n.startswith('op') or n == 'pipeline'])"
    run = subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert run.returncode == 0 and run.stdout.strip() == "[]", run.stderr
    assert ("left out" in run.stderr) == (missing == "library")
