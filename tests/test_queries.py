"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import os

import duckdb
import pytest

from lumenframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(wanted.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, found.select(*columns).collect())) == plain(wanted.select(quoted).fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
