import pytest
from foliograph.llm import catalogue

from tests.test_catalogue import SF, by_duckdb, rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(by_duckdb(catalogue.ORACLES[name]))


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 11))
