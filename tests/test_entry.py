"""The driver contract without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("left", ["nothing", "an empty folder"])
def test_entry_without_training_data_operators(tmp_path, left):
    shutil.copytree(REPO / "tidepool", tmp_path / "tidepool", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if left == "an empty folder":
        (tmp_path / "tidepool/llm").mkdir()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
