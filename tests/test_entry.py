"""The entry module with and without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_names_match(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(HERE / "tempograph", tmp_path / "tempograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
