"""The repository without its text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path


def test_entry_without_text_operators(tmp_path):
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(k.startswith('op') for k in q), set(o) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"}).stdout.split()
    assert int(out[0]) > 30 and out[1:] == ["False", "False", "True"]
