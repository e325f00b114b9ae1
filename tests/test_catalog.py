"""Every catalogued query against its SQL on the smallest tables; those without SQL must return rows."""

import pytest

from stratablock.plans.catalog import ORACLES, QUERIES
from tests.conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert found.count() > 0
        return
    names, want = duck_rows(duck, ORACLES[name])
    assert sorted(found.columns) == names
    assert rows_of(found) == want


def test_entry_imports_without_the_optional_parts(tmp_path):
    """The driver contract holds when the optional subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "stratablock", tmp_path / "stratablock", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'dedup_summary' in q and set(o) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
