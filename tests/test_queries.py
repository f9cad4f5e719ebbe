import os

import duckdb
import pytest

import __spark_entry__ as entry
from folioseek.plans.oracle import ORACLE
from folioseek.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toArrow()
    sql.register("got", got)
    sql.execute(f"CREATE OR REPLACE TEMP TABLE want AS {ORACLE[name]}")
    cols = ", ".join(f'"{c}"' for c in got.column_names)
    for a, b in (("got", "want"), ("want", "got")):
        assert sql.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b} LIMIT 3").fetchall() == []
