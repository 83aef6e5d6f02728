"""The operators' queries against their SQL on DuckDB."""

import duckdb
import pytest

from quernix.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == want
