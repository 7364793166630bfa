import pytest
from oracle import compare

from meshlark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, name):
    compare(spark, name, QUERIES, ORACLE_SQL, "/root/testdata/sf0.01")


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
