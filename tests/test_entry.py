"""The driver's contract, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.registry.FLAGSHIP in e.queries()


def test_imports_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
