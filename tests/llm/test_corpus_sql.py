"""Corpus queries that SQL can express equal DuckDB on the same tables."""

import duckdb
import pytest

from scholia.llm import queries as Q

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(Q.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    got = Q.QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
