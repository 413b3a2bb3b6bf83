"""Every own query against its SQL, on the smallest tables."""

import sys

import duckdb
import pytest

sys.path.insert(0, ".")
from veilspark.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def shown(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows), sorted(names)


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_against_sql(spark, small, sql, name):
    df = own.QUERIES[name](spark, small)
    r = sql.execute(own.ORACLE[name])
    names = [c[0] for c in r.description]
    assert shown([tuple(x) for x in df.collect()], df.columns) == shown(r.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE)))
def test_runs(spark, small, name):
    df = own.QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
