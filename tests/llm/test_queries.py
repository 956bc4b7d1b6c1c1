"""The registered queries with SQL, on the driver's tables."""

import pytest

import __spark_entry__ as entry
from codexa.llm import registry
from tests.oracle import DATA, duck, same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    same(registry.QUERIES[name](spark, f"{DATA}/sf0.01"), duck(f"{DATA}/sf0.01"), registry.ORACLE_SQL[name])


def test_all_eleven_are_registered():
    found = entry.queries()
    assert "pipeline" in found and set(entry.oracle_sql()) <= set(found)
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in found)] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted([*registry.QUERIES, "pipeline"]))
def test_runs_on_the_smallest_tables(spark, name):
    assert entry.queries()[name](spark, f"{DATA}/sf0.001").count() > 0
