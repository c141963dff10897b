"""The entry module where the training-data operators are not installed."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
LISTS = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') for k in e.queries()), 'pipeline' in e.queries())"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LISTS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_data_operators(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "opinweave", tmp_path / "opinweave", ignore=left_out)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    n, numbered, has_pipeline = listed(tmp_path)
    assert int(n) > 90 and numbered == "0" and has_pipeline == "False"
