"""Every query of the library against its DuckDB counterpart on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from jobs import registry as jobs
from tessella.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(names, values):
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES | jobs.ORACLES))
def test_same_rows(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    expected = duck.sql(contract.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, name):
    assert contract.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    row = contract.entry(spark).first()
    assert 0 < row["n"] and 0 <= row["accuracy"] <= 1
