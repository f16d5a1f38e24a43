"""Bars, indicators, zones and trades against straight-line versions written from the definitions."""

import random

import pytest

from barline.config import Config, TradeConfig, ZoneConfig
from barline.operators import indicators, labels, metrics, models, patterns, trades, windows, zones
from barline.plans.ranks import ranked
from barline.sources import bars as sources

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(symbol, n, seed):
    import datetime as dt

    rng, c, out = random.Random(seed), 10_000, []
    for k in range(n):
        o = c
        c = max(100, o + rng.choice([-1, 1]) * (rng.randint(0, 30) if rng.random() < 0.6 else rng.randint(40, 160)))
        h, low = max(o, c) + rng.randint(0, 20), min(o, c) - rng.randint(0, 20)
        out.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), o / 100, h / 100, low / 100, c / 100, float(rng.randint(1, 500))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = walk("A", 400, 1) + walk("B", 700, 2) + walk("C", 5, 3)
    return rows, indicators.with_indicators(spark.createDataFrame(rows, BAR)).persist()


def test_exponential_means(made):
    rows, bars = made
    got = {(r.symbol, r.idx): r for r in bars.collect()}
    for s in "ABC":
        own, e200, atr, before = [r for r in rows if r[0] == s], None, None, None
        for k, (_, _, o, h, low, c, _) in enumerate(own):
            tr = h - low if before is None else max(h - low, abs(h - before), abs(low - before))
            e200 = c if e200 is None else e200 + 2 / 201 * (c - e200)
            atr = tr if atr is None else atr + (tr - atr) / 14
            before = c
            assert got[s, k].ema200 == pytest.approx(e200, rel=1e-12)
            assert got[s, k].atr == (pytest.approx(atr, rel=1e-10) if k >= 13 else None)


def expected_zones(bars, z):
    """Bar by bar: the bases, legs and gates that raw_zones finds without loops."""
    out, n = [], len(bars)
    base = [b.atr is not None and b.atr > 0 and b.high - b.low <= z.base_range * b.atr and abs(b.close - b.open) <= z.base_body * b.atr for b in bars]
    for e in range(n - 1):
        run = 0
        while run < z.max_base and e - run >= 0 and base[e - run]:
            run += 1
        for k in range(run, 0, -1):
            part = bars[e - k + 1 : e + 1]
            atr, top, bottom = sum(b.atr for b in part) / k, max(b.high for b in part), min(b.low for b in part)
            if top - bottom <= z.base_cluster * atr:
                break
        else:
            continue
        f, s = bars[e + 1], e - k + 1
        span = f.high - f.low
        if span < 1e-10 or s == 0:
            continue
        up = f.close >= f.open
        strong = ((f.close - f.low) if up else (f.high - f.close)) / span
        ext, at = f.close, 1
        for j in range(2, z.leg_max + 1):
            if e + j >= n:
                break
            c = bars[e + j].close
            if (c > ext) if up else (c < ext):
                ext, at = c, j
            elif abs(ext - c) >= z.leg_pullback * atr:
                break
        clear = ((ext - top) if up else (bottom - ext)) / atr
        if strong < z.departure_close or abs(f.close - f.open) / atr < z.departure_floor or clear < z.leg_clear:
            continue
        first = max(0, s - z.leg_in_lookback)
        net = bars[s - 1].close - bars[first].open
        high, low = max(max(b.open, b.close) for b in part), min(min(b.open, b.close) for b in part)
        inside = (high < f.close) if up else (low > f.close)
        prior = bars[s - 1].open
        inside &= (high < prior) if net < 0 else (low > prior) if net > 0 else True
        if inside:
            came = "R" if net > 0 else "D" if net < 0 else ("D" if up else "R")
            out.append((bars[0].symbol, e, k, came + "B" + ("R" if up else "D"), at))
    return out


def test_zones(made):
    _, bars = made
    z = ZoneConfig(base_range=1.2, departure_close=0.6, leg_clear=0.3, departure_floor=0.5)
    rows = sorted(bars.collect(), key=lambda r: (r.symbol, r.idx))
    want = [x for s in "ABC" for x in expected_zones([r for r in rows if r.symbol == s], z)]
    got = zones.raw_zones(bars, z).select("symbol", "base_idx", "n", "structure", "leg_n").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20


def test_merge_lifecycle_and_trades(made):
    _, bars = made
    z = ZoneConfig(base_range=1.2, departure_close=0.6, leg_clear=0.3, departure_floor=0.5)
    found = zones.scored_zones(bars, z).persist()
    rows = sorted(found.collect(), key=lambda r: (r.symbol, r.formation_idx, r.zone_id))
    kept = []
    for r in rows:
        for k in kept:
            m = k["z"]
            overlap, height = min(m.top, r.top) - max(m.bottom, r.bottom), min(m.top - m.bottom, r.top - r.bottom)
            if m.symbol == r.symbol and m.type == r.type and height > 0 and overlap > 0 and overlap >= z.merge_overlap * height and abs(m.formation_idx - r.formation_idx) <= z.merge_gap:
                k["n"] += 1
                if r.quality_score > m.quality_score:
                    k["z"] = r
                break
        else:
            kept.append({"z": r, "n": 1})
    merged = zones.merged(found, z).collect()
    assert sorted((r.symbol, r.zone_id, r.merged_count) for r in merged) == sorted((k["z"].symbol, k["z"].zone_id, k["n"]) for k in kept)
    series = {}
    for b in sorted(bars.collect(), key=lambda b: b.idx):
        series.setdefault(b.symbol, []).append(b)
    life = {(r.symbol, r.zone_id): r for r in zones.lifecycle(found, bars, z).collect()}
    t = TradeConfig(trail=True, max_hold=20)
    fixed, trailing = ({(r.symbol, r.zone_id): r for r in trades.simulate(found, bars, x).collect()} for x in (TradeConfig(), t))
    for r in rows:
        own, tests, status, inside = series[r.symbol][r.formation_idx + 1 :], 0, "active", False
        for b in own:
            if b.close < r.bottom if r.type == "demand" else b.close > r.top:
                status = "broken"
                break
            now = b.low <= r.top and b.high >= r.bottom
            tests, inside = tests + (now and not inside), now
        got = life[r.symbol, r.zone_id]
        assert (got.test_count, got.status) == (tests, "tested" if status == "active" and tests else status)
        for table, one in ((fixed, TradeConfig()), (trailing, t)):
            want, trade = stepped(r, own, one), table.get((r.symbol, r.zone_id))
            assert (trade and (trade.outcome, trade.hold_candles, trade.exit_price)) == (want and (want[0], want[1], pytest.approx(want[2])))


def stepped(z, bars, t):
    """One trade, bar by bar: outcome, bars held, exit price."""
    side, opened, fill = (1 if z.type == "demand" else -1), False, None
    for k, b in enumerate(bars):
        if (b.low < z.distal) if side > 0 else (b.high > z.distal):
            return None
        opened = opened or ((b.low <= z.top) if side > 0 else (b.high >= z.bottom))
        if opened and ((b.high >= z.proximal) if side > 0 else (b.low <= z.proximal)):
            fill = k
            break
    risk = abs(z.proximal - z.distal)
    if fill is None or risk == 0:
        return None
    stop, target, trigger = z.distal * side, z.proximal * side + t.reward * risk, z.proximal * side + t.trail_trigger * risk
    best = on = None
    for hold, b in enumerate(bars[fill + 1 :]):
        worst, high = (b.low, b.high) if side > 0 else (-b.high, -b.low)
        if hold >= t.max_hold:
            return "timeout", hold, b.close
        if on is None and worst <= stop:
            return "loss", hold, stop * side
        if not t.trail and high >= target:
            return "win", hold, target * side
        if t.trail and on is None and high >= trigger:
            on = best = high
            if b.atr and b.atr > 0:
                stop = max(stop, best - t.trail_atr * b.atr, trigger - t.trail_floor * b.atr)
            if worst <= stop:
                return "trail_win", hold + 1, stop * side
        elif on is not None:
            if b.atr and b.atr > 0:
                best = max(best, high)
                stop = max(stop, best - t.trail_atr * b.atr)
            if worst <= stop:
                return "trail_win", hold, stop * side
    return None


def test_equity_compounds(made):
    _, bars = made
    z = ZoneConfig(base_range=1.2, departure_close=0.6, leg_clear=0.3, departure_floor=0.5)
    curve = sorted(trades.equity(trades.simulate(zones.scored_zones(bars, z), bars)).collect(), key=lambda r: (r.symbol, r.seq))
    capital = {}
    for r in curve:
        had = capital.get(r.symbol, 500_000.0)
        assert r.capital_at_entry == pytest.approx(had, abs=0.011)
        capital[r.symbol] = had + r.net_pnl
    assert curve


def test_ranks_and_folds(spark):
    rows = spark.range(103).selectExpr("id", "(id * 37) % 103 as v")
    got, n = ranked(rows, ["v"])
    assert n == 103 and all(r["rank"] == r.v + 1 for r in got.collect())
    counts = {r.fold: r["count"] for r in models.folds(rows, ["v"], 5).groupBy("fold").count().collect()}
    assert counts == {0: 18} | {k: 17 for k in range(1, 6)}


def test_rebuilt_windows_and_patterns(made):
    _, bars = made
    assert len(windows.names()) == 145 and len(windows.features(bars).columns) == 149
    flags = patterns.candle_patterns(bars).collect()
    assert all(sum(r[2:]) > 0 for r in flags)


def test_config():
    c = Config.from_mapping({"zones": {"leg_max": 3}})
    assert c.zones.leg_max == 3 and c.trades.reward == 2.0
    with pytest.raises(ValueError):
        Config.from_mapping({"zones": {"leg_maxx": 3}})


def test_empty_input(spark):
    bars = indicators.with_indicators(spark.createDataFrame([], BAR))
    assert zones.detect(bars).count() == 0
    with pytest.raises(ValueError):
        zones.bases(spark.createDataFrame([], "symbol string, ts timestamp_ntz, open double"))


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02 00:00:00+05:30,1,2,0.5,x,\n")
    row = sources.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert str(row.ts) == "2024-01-02 00:00:00" and row.open == 1.0 and row.close is None and row.symbol is None


def test_streamed_bars(spark, sf_dir, tmp_path):
    from barline.streaming import bars as streaming

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.withColumn("ts", events.ts.cast("timestamp")).repartition(1).write.parquet(str(tmp_path / "in"))
    made = streaming.stream_bars(streaming.read_ticks(spark, str(tmp_path / "in")))
    streaming.write_bars(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
