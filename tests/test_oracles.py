"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgrain.plans import registry
from tools.compare import rows

DATA = Path("/root/testdata/sf0.001")
ORACLES, QUERIES = registry.oracles(), registry.queries()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, str(DATA))
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_sql_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
