import os

import duckdb
import pytest

from contextloom import fixture_queries, queries  # noqa: F401  the first adds its queries to the second

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in TABLES:
        found.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return found


def near(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, db, name):
    want = db.sql(queries.SQL[name])
    columns = sorted(want.columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = [tuple(near(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(near(r[i]) for i in at) for r in want.fetchall()), key=repr)
