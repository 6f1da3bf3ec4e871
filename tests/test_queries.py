"""Every registered query of the spatial operators against its SQL in DuckDB."""

import glob
import math
import os

import pytest

from stratalode.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def clean(rows, at):
    def one(v):
        return None if isinstance(v, float) and not math.isfinite(v) else v

    def order(r):  # what is no float first; floats, which may differ in their last digits, then by four
        return [(v is None, "" if v is None else str(v)) for v in r if not isinstance(v, float)], [f"{v:.4e}" for v in r if isinstance(v, float)]

    return sorted(([one(r[i]) for i in at] for r in rows), key=order)


def close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 2e-6 * max(1e-9, abs(a), abs(b))
    return a == b


@pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a = clean(df.collect(), [df.columns.index(c) for c in sorted(df.columns)])
    b = clean(want.fetchall(), [want.columns.index(c) for c in sorted(want.columns)])
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(close, x, y))] == []
