"""The driver's contract holds without the optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["ahocorasick", "tidewater.llm", "corpus_pipeline", "xxhash"])
def test_core_queries_stay_without(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nfrom tidewater import queries as core\nassert set(e.queries()) >= set(core.queries()) and set(e.oracle_sql()) >= set(core.oracle_sql())\nprint(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
