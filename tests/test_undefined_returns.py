"""Prices that fall below zero, or stand at it: their returns have no value but aren't missing, and queries over them follow their SQL."""

import datetime as dt
import math
import random

import duckdb
import pytest

from barline.operators import indicators, quality
from barline.plans import registry

START = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def sunk(spark, tmp_path_factory):
    """A folder of `events` with four an hour: prices of one symbol cross zero again and again, those of another stand on it at times, those of a third stay far above."""
    rng, rows = random.Random(7), []
    for symbol, start, most in (("crossing", -99_000, 9_000), ("even", -99_990, 5), ("far", 0, 700)):
        moves = [start] + [rng.choice([-1, 1]) * rng.randint(1, most if rng.random() < 0.3 else most // 4 + 1) for _ in range(1199)]
        rows += [(START + dt.timedelta(minutes=15 * k), symbol, m) for k, m in enumerate(moves)]
    rows.sort(key=lambda r: r[:2])
    path = str(tmp_path_factory.mktemp("sunk"))
    made = [(2 * k + (m < 0), ts, symbol, float(abs(m))) for k, (ts, symbol, m) in enumerate(rows)]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def sql(sunk):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{sunk}/events.parquet/*.parquet')")
    return con


def shown(rows):
    """Rows in order; NaN is told from null, and whole numbers aren't told from doubles."""
    return sorted(tuple(str(round(x, 6) + 0.0) if isinstance(x, int | float) else str(x) for x in r) for r in rows)


def agrees(spark, sunk, sql, name):
    want = sql.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got, held = shown(registry.QUERIES[name](spark, sunk).select(columns).collect()), shown(want.fetchall())
    assert held and got == held
    return held


def test_returns_without_a_value(spark):
    closes = [2.0, 4.0, -4.0, -2.0, 0.0, 0.0, 3.0, 0.0, -3.0, 3.0]
    rows = [("A", START + dt.timedelta(hours=k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
    got = [r.log_return for r in indicators.with_indicators(spark.createDataFrame(rows, BAR)).orderBy("ts").collect()]
    nan, inf = math.nan, math.inf
    want = [None, math.log(2), nan, math.log(0.5), -inf, nan, inf, -inf, nan, nan]
    assert [str(x) for x in got] == [str(x) for x in want]
    assert [str(x) for (x,) in duckdb.sql(f"select ln(c / lag(c) over (order by k)) from (select unnest({closes}::double[]) as c, unnest(range({len(closes)})) as k) order by k").fetchall()] == [str(x) for x in want]


def test_indicators(spark, sunk, sql):
    assert sum("nan" in r for r in agrees(spark, sunk, sql, "indicators")) > 100


def test_plotting_positions(spark, sunk, sql):
    agrees(spark, sunk, sql, "plotting_positions")


def test_tail_frequency(spark, sunk, sql):
    agrees(spark, sunk, sql, "tail_frequency")


def test_quality_nulls(spark, sunk, sql):
    agrees(spark, sunk, sql, "quality_nulls")


def test_example_nulls(spark, sunk, sql):
    agrees(spark, sunk, sql, "example_nulls")


def test_quality_describe(spark, sunk, sql):
    agrees(spark, sunk, sql, "quality_describe")


def test_volume_links(spark, sunk, sql):
    agrees(spark, sunk, sql, "volume_links")


def test_return_histogram(spark, sunk, sql):
    agrees(spark, sunk, sql, "return_histogram")


def test_histogram_bins(spark):
    values = [-1.0, -0.5, -0.1, 0.0, 0.49, 0.5, 7.0, math.inf, -math.inf, math.nan, None]
    got = quality.histogram(spark.createDataFrame([("A", v) for v in values], "symbol string, v double"), "v", -0.5, 0.5, 10)
    assert sorted((r.bin, r.bars) for r in got.collect()) == [(0, 2), (1, 1), (5, 1), (6, 1), (10, 1), (11, 4)]
