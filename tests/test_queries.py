"""Every query with SQL against DuckDB, over the smallest tables; the others give rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("op") and n != "pipeline"))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [d[0] for d in cursor.description]
        rows = cursor.fetchall()
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
        assert got == want
    else:
        assert got or name in ("hash_dups", "merge_groups")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_known():
    assert set(SQL) <= set(QUERIES)
