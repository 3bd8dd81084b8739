"""The driver's contract holds with the corpus folders and with any part of them gone."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [(), ("seriesloom/llm", "tests/llm"), ("corpus_pipeline.py",), ("seriesloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_folders(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}") and name not in gone:
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/seriesloom", tmp_path / "seriesloom")
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    queries, sql = json.loads(done.stdout)
    assert "promql_sum_count_over_time" in queries and set(sql) <= set(queries)
    there = os.path.isdir(tmp_path / "seriesloom/llm")
    assert any(q.startswith("op1_") for q in queries) == there
    assert ("pipeline" in queries) == (there and os.path.exists(tmp_path / "corpus_pipeline.py"))
