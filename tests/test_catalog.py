import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.operators import catalog
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows):
    norm = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v.isoformat() if isinstance(v, datetime.datetime) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not n.startswith(("store_", "bench_", "preset_")) or n in ("store_nan_filter", "store_sum_eq", "store_count_or", "bench_sum_level_gt500_limit1000", "preset_09")])
def test_query_equals_its_sql(spark, db, name):
    got = catalog.queries()[name](spark, SMALL)
    rows = got.collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = db.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    assert plain([tuple(r[c] for c in want.columns) for r in rows]) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
