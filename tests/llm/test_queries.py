"""Queries of the training-data operators with an SQL twin, against DuckDB on the smallest tables."""

import pytest

import tests.test_queries as core
from kinelake.llm import queries

duck = core.duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin_of_training_data(spark, sf, duck, name):
    core.test_sql_twin(spark, sf, duck, name)
