"""Every registered query of the reference's operators against its DuckDB SQL at the smallest scale."""

import pytest
from conftest import same_rows

from atlasforge.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, DIR), duck.sql(registry.ORACLES[name]))


def test_every_query_has_rows_or_an_oracle():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_without_the_training_subpackage(tmp_path):
    """A copy of the repository without the subpackage and the pipeline imports and registers all the other queries; a broken subpackage is an error."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/atlasforge", tmp_path / "atlasforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLES))]
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    assert run().returncode != 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
