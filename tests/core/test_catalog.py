"""Every catalogued query against its SQL, as the driver compares them: columns by name, rows in any order."""

import duckdb
import pytest

from pitwall import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet') AS src")
    return con


def rows(columns, records):
    norm = lambda v: None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v) if not isinstance(v, bool | int | str) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want, got = rows(columns, found.fetchall()), rows(df.columns, df.collect())
    assert len(want) == len(got)
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
