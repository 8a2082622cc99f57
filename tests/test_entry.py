"""The entry module of a copy of the tree without the text folders."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from tidemark import catalog

COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [False, True])
def test_loads_without_text_folders(tmp_path, pipeline):
    """Also where corpus_pipeline.py stayed behind: it belongs to the text operators."""
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, capture_output=True, text=True, check=True).stdout
    queries, sql = catalog.load()
    assert out.split() == [str(len(queries)), str(len(sql))]
