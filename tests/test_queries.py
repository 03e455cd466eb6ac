"""Every query with SQL against that SQL, every other one for its rows; the entry's guard."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from cohortloom.plans import registry

from .oracle import difference

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equal_to_sql(spark, name):
    assert difference(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_training_data_subpackage(tmp_path):
    import shutil

    root = Path(entry.__file__).parent
    for p in root.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            shutil.copy(p, tmp_path)
    shutil.copytree(root / "cohortloom", tmp_path / "cohortloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and '_' in n and n[2].isdigit()]; assert 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
