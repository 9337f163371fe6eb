from pathlib import Path

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, str(SF))
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert text(df.select(*names).collect()) == text(tuple(r[i] for i in at) for r in want.fetchall())


def test_contract_functions_agree():
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(QUERIES) <= set(q) and set(sql) <= set(q)
