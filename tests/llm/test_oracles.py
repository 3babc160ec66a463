"""Operators that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from shotlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, spark, sf_dir):
    duck = duckdb.connect()
    for t in os.listdir(sf_dir):
        duck.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    theirs = duck.sql(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(repr, theirs))
