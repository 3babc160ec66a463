"""Every registered query of the event library against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from shotlake import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in os.listdir(SF):
        connection.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return connection


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, duck):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    theirs = duck.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({registry.ORACLES[name]})").fetchall()
    ours = df.select(*columns).collect()
    assert sorted(tuple(map(plain, r)) for r in ours) == sorted(tuple(map(plain, r)) for r in theirs)


def test_every_query_without_sql_is_a_fit():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"logistic_fit", "final_refit", "oof_scores", "grid_select_c", "gbt_fit", "mlp_fit", "fit_platt"}
