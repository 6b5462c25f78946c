"""Every query with an SQL twin against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinelake.plans import general, reference, robot

CORE = {**general.SQL, **reference.SQL, **robot.SQL}

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_sql_twin(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    told = duck.sql(entry.oracle_sql()[name])
    assert {c: KINDS[k] for c, k in got.dtypes} == {c: str(k) for c, k in zip(told.columns, told.types)}
    a, b = rows(got.toPandas()), rows(told.df())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-5) if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x) else x == y


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["pose_formats", "fk_arms", "p2_found", "p5_found", "p5_layout"])
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0
