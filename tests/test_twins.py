"""Every registered relational query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from codestrata.plans import twins

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)

    def plain(x):
        if pd.isna(x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(twins.queries()))
def test_twin(spark, database, name):
    found = rows(twins.queries()[name](spark, FOLDER).toPandas())
    wanted = rows(database.sql(twins.oracle_sql()[name]).df())
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
