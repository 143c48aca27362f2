"""Entry points import where no Spark session runs, as in the workers."""

import subprocess
import sys
from pathlib import Path


def test_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr
