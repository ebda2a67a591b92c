"""Every named query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tempolake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    found = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=str)


def test_row_crc32(spark):
    import zlib

    rows = catalog.events_log(spark, SF).select("event_id", "v").collect()
    assert {r.event_id: r.crc32 for r in catalog.row_crc32(spark, SF).collect()} == {r.event_id: zlib.crc32(r.v.encode()) for r in rows}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("name", "pushed"), [("get_point", ("EqualTo(user_id,42)", "LessThanOrEqual(t")), ("snapshot_asof", ("LessThanOrEqual(t",)), ("range_latest", ("GreaterThanOrEqual(ts,", "LessThanOrEqual(t"))])
def test_bounds_reach_the_scan(spark, name, pushed):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.split("\n") if "PushedFilters" in x).split("PushedFilters")[1]
    assert all(p in filters for p in pushed), filters
