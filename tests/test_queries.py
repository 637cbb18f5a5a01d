"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from parallax.plans.source_queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", [*QUERIES])
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    wanted = db.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    assert plain(map(tuple, got.select(*columns).collect())) == plain(wanted.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_has_an_oracle_for_every_sql_query(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() >= 0
