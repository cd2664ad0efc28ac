"""Queries that SQL can express against their SQL."""

import duckdb
import pytest

from evenground.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, llm_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{llm_dir}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = queries.queries()[name](spark, llm_dir)
    assert sorted(columns) == sorted(got.columns)
    shown = lambda rows: sorted(tuple(f"{v:.12g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(got.select(*columns).collect()) == shown(result.fetchall())
