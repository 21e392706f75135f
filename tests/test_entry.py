"""The entry points, and that the core stands by itself."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_imports_nothing_of_the_corpus_operators():
    for p in (ROOT / "tessel").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) +[\w.]*llm|corpus_pipeline", p.read_text()), p


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "tessel", tmp_path / "tessel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'take' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
