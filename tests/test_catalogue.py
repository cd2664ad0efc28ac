"""Every catalogued query against its SQL on the smallest tables."""

import duckdb
import pytest

from evenground.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def connection(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def shown(rows):
    def one(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, data_dir, connection, name):
    got = catalogue.queries()[name](spark, data_dir)
    result = connection.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    assert shown(got.select(*columns).collect()) == shown(result.fetchall())
