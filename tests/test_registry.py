"""The registry, and that everything but the training-data operators stands without them."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).parent.parent


def test_sql_belongs_to_queries():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and len(names) > 100
    assert all(callable(f) for f in names.values())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["c_mktsegment", "total", "n", "share"]


def test_stands_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') or n == 'pipeline'], q; print(len(q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, timeout=120)
    assert int(out.stdout.split()[0]) > 100


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "gristmill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gristmill.llm" not in path.read_text(encoding="utf-8"), path
