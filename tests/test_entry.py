"""The entry module without the optional folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_the_training_data_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "cohortspark", tmp_path / "cohortspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "daily_rollup" in names and "pipeline" not in names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit()]
