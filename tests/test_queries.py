"""Every query that has SQL gives the SQL's rows; the others run."""

import pytest
from conftest import DATA, plain

from lectern import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_stands_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(queries.__file__).parent.parent
    shutil.copytree(root / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
