"""The driver contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(REPO / "spectrail", tmp_path / "spectrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') and q[2:3].isdigit() for q in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1] == "False", said.stderr
