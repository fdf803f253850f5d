"""Every query with SQL returns what the other engine does, on the smallest tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from prospectra.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(records, columns):
    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.9g}"

    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {Path(f).stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows([r.asDict() for r in got.collect()], columns) == rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
