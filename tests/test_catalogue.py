import pytest
from tests.compare import duck_rows, spark_rows

from wirelattice.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == duck_rows(catalogue.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_need_the_llm_subpackage():
    import pathlib
    import re

    root = pathlib.Path(catalogue.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"wirelattice\.llm|corpus_pipeline", p.read_text()), p
