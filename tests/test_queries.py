import math

import duckdb
import pytest

import __spark_entry__

TABLES = ("orders", "part", "supplier")
SF = "/root/testdata/sf0.001"


def _row(values):
    return tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in values)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.counting.QUERIES)))
def test_against_sql(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = db.sql(__spark_entry__.oracle_sql()[name])
        names = sorted(want.columns)
        rows = [_row(r) for r in want.select(*names).fetchall()]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    key = lambda r: tuple((v is None, v) if v is None else (False, v) for v in r)
    assert sorted([_row(r) for r in got.select(*names).collect()], key=str) == sorted(rows, key=str) or sorted(map(key, [_row(r) for r in got.select(*names).collect()])) == sorted(map(key, rows))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
