"""The driver's contract."""

import __spark_entry__
from barline.plans import registry


def test_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(registry.ORACLES) <= set(registry.QUERIES)


def test_small_queries_match_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sf_dir}/events.parquet')")
    for name in ("bars_ohlcv", "quality_integrity", "quality_gaps", "swing_points", "price_clusters", "buy_and_hold"):
        got = registry.QUERIES[name](spark, sf_dir)
        want = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in want.description]
        key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
        assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.fetchall())), name
