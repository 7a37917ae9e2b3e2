"""The entry without the llm folders, and rows that no rule accepts."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT, rows
from pyspark.sql import functions as F

from mnemolake.operators import lifecycle, store


def test_entry_without_the_llm_folders(tmp_path):
    """A copy without them imports, keeps all other queries and runs one; the pipeline goes with them."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = (
        "import __spark_entry__ as e; from mnemolake.session import build_session\n"
        "q = e.queries(); assert len(q) > 110 and 'pipeline' not in q and not any(n.startswith('op1') for n in q)\n"
        "assert 'pipeline' not in e.oracle_sql()\n"
        "s = build_session('copy', 'local[2]', spark__ui__enabled='false'); print('ROWS', q['age_days'](s, '/root/testdata/sf0.001').count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]


def test_rows_without_a_verdict_are_dead_letters(spark):
    cells = spark.createDataFrame(
        [("a", "t", "u", "short", [1.0], 1.0), ("b", "t", "u", None, [1.0], None), ("c", "t", "u", None, None, None)],
        "mem_cell_id string, tenant_id string, user_id string, text string, embedding array<float>, importance_score double",
    )
    docs, vectors, dead = store.index_fanout(cells, F.lit(0), F.length("text") <= 20, F.col("importance_score") > -10)
    assert rows(docs, "mem_cell_id") == [("a",)] and rows(vectors, "mem_cell_id") == [("a",)]
    assert rows(dead, "target", "mem_cell_id") == [("es", "b"), ("es", "c"), ("milvus", "b")]


def test_capacity_ranks_scores_that_differ_little(spark):
    cells = spark.createDataFrame(
        [("t", "u", f"c{i}", "ACTIVE", 0.5 + (9 - i) * 1e-9) for i in range(10)],
        "tenant_id string, user_id string, mem_cell_id string, state string, s double",
    )
    got = lifecycle.enforce_capacity(cells, F.col("s"), 7, 0.3)
    assert rows(got, "mem_cell_id", "position") == [("c7", 3), ("c8", 2), ("c9", 1)]
