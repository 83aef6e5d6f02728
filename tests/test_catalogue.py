"""Every query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from quernix.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    if name not in catalogue.ORACLES:
        assert got
        return
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert got == want
