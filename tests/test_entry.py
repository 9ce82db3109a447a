"""The driver's entry point, with and without the optional operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len([q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]) >= 60


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns


def test_imports_without_the_optional_operators(tmp_path):
    for p in ("__spark_entry__.py", "quarry"):
        src = os.path.join(ROOT, p)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(src, tmp_path / p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
