"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandfold.plans.registry import ORACLES, QUERIES

TABLES = "customer part orders lineitem events documents embeddings labels".split()
#: The numbers of trained models: their checked forms run below, they themselves do the same work again.
VALUES = [n for n in QUERIES if n.endswith("_values")]


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data_dir}/{table}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(float(v) + 0.0) if isinstance(v, (int, float)) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, data_dir, duck, name):
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = [tuple(r[found.index(c)] for c in columns) for r in cursor.fetchall()]
    assert plain([tuple(r[c] for c in columns) for r in df.collect()]) == plain(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES and n not in VALUES])
def test_query_runs(spark, data_dir, name):
    assert QUERIES[name](spark, data_dir).count() > 0


def test_every_value_query_has_a_checked_form():
    assert VALUES and {n.removesuffix("_values") for n in VALUES} <= set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
