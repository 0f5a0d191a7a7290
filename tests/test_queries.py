"""Every registered query against its SQL twin on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as entry_points
from adinsight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES = catalogue.queries()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.fixture(scope="module")
def results(spark):
    """Futures of (columns, rows) per query; a few queries run at a time."""

    def run(name):
        df = QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        return columns, sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in sorted(QUERIES)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_oracle(results, duck, name):
    columns, got = results[name].result(timeout=600)
    if name not in ORACLES:
        assert got
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
