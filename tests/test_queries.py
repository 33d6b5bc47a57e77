"""Every registered query against its SQL over the smallest tables; what has no SQL must give rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def cell(v):
    if v is None or isinstance(v, (bool, str)):
        return f"{type(v).__name__}:{v}"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name not in entry.oracle_sql():
        return
    got = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert {d[0]: str(d[1]) for d in got.description} == {c: TYPES[t] for c, t in df.dtypes}
    assert sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in got.fetchall()) == rows


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
