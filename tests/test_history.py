"""First hits and all hits in the pyramid of bars against scans, and how the pairs they make grow."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.operators import history, zones

START = dt.datetime(2024, 1, 1)


def price_path(n, seed, symbol="A"):
    rng, c, out = random.Random(seed), 1000, []
    for k in range(n):
        o, c = c, max(10, c + rng.randint(-9, 9) + (rng.choice([-60, 60]) if rng.random() < 0.02 else 0))
        out.append((symbol, k, START + dt.timedelta(minutes=k), float(max(o, c) + rng.randint(0, 3)), float(min(o, c) - rng.randint(0, 3)), float(c), 5.0))
    return out


def framed(spark, rows):
    return spark.createDataFrame(rows, "symbol string, idx long, ts timestamp_ntz, high double, low double, close double, atr double")


def questions(rng, rows, n):
    """symbol, zone_id, type, top, bottom, after, before"""
    out = []
    for k in range(n):
        s, i, _, high, low, c, _ = rng.choice(rows)
        bottom = c + rng.randint(-40, 40)
        out.append((s, f"Z{k}", rng.choice(["demand", "supply"]), bottom + rng.randint(0, 12) + 0.5, bottom - 0.25, i, rng.choice([None, i + rng.randint(1, 900)])))
    return out


ASKED = "symbol string, zone_id string, type string, top double, bottom double, after long, before long"


@pytest.fixture(scope="module")
def walked():
    rows = price_path(3000, 1) + price_path(150, 2, "B") + price_path(1, 3, "C")
    asked = questions(random.Random(4), rows, 300) + [("D", "none", "demand", 1.0, 0.0, 5, None)]
    return rows, asked


@pytest.mark.parametrize("fan", [4, 64])
def test_hits_are_those_of_a_scan(spark, walked, monkeypatch, fan):
    monkeypatch.setattr(history, "FAN", fan)
    rows, asked = walked
    series = {}
    for r in rows:
        series.setdefault(r[0], []).append(r)
    tree = history.Pyramid(framed(spark, rows))
    assert tree.levels == {4: 5, 64: 1}[fan]
    q = spark.createDataFrame(asked, ASKED)
    later = lambda s, after, before: [r for r in series.get(s, []) if r[1] > after and (before is None or r[1] < before)]
    breaks = {(z[0], z[1]): next((r[1] for r in later(z[0], z[5], None) if (r[5] < z[4] if z[2] == "demand" else r[5] > z[3])), None) for z in asked}
    got = tree.first(q.drop("before"), lambda: F.when(F.col("type") == "demand", F.col("low_close") < F.col("bottom")).otherwise(F.col("high_close") > F.col("top")))
    assert {(r.symbol, r.zone_id): r["at"] for r in got.collect()} == {k: v for k, v in breaks.items() if v is not None}
    every = {(z[0], z[1], r[1]) for z in asked for r in later(z[0], z[5], z[6]) if r[4] <= z[3] and r[3] >= z[4]}
    found = tree.hits(q, zones.overlapping).collect()
    assert len(found) == len(every) and {(r.symbol, r.zone_id, r["at"]) for r in found} == every
    assert all(r.bar_ts == START + dt.timedelta(minutes=r["at"]) and r.atr == 5.0 for r in found)
    # prices jump over narrow zones, so that a search can end in vain
    inside = {(z[0], z[1]): next((r[1] for r in later(z[0], z[5], z[6]) if z[4] <= r[5] <= z[3]), None) for z in asked}
    got = {(r.symbol, r.zone_id): (r["at"], r.after) for r in tree.first(q, zones.closing_inside, exact=False).collect()}
    assert got == {(z[0], z[1]): (inside[z[0], z[1]], z[5]) for z in asked if inside[z[0], z[1]] is not None}


def test_empty_history(spark):
    tree = history.Pyramid(framed(spark, []))
    assert tree.first(spark.createDataFrame([("A", "Z", "demand", 2.0, 1.0, 0, None)], ASKED), zones.overlapping, exact=False).count() == 0


def test_pairs_grow_with_the_logarithm_of_the_bars(spark):
    """A question that nothing answers meets one parent's nodes on each level."""
    made = []
    for n in (4_000, 40_000, 400_000):
        bars = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.lit(START).alias("ts"), F.lit(10.0).alias("high"), F.lit(9.0).alias("low"), F.lit(9.5).alias("close"))
        tree = history.Pyramid(bars)
        asked = spark.range(50).select(F.lit("A").alias("symbol"), F.col("id").alias("zone_id"), (F.col("id") * 50).alias("after"))
        made.append((tree._tiled(asked, lambda: F.col("low") < 100).count(), tree.first(asked, lambda: F.col("low") < 1).count()))
    assert all(x[1] == 0 for x in made)
    assert made[2][0] <= 50 * history.FAN * 4 and made[2][0] < 2.5 * made[0][0]


def test_context_is_that_of_a_scan(spark, monkeypatch):
    """Any zones, whatever ended them, on a path that jumps; ties of price and formation among them."""
    from barline.operators import labels

    monkeypatch.setattr(labels, "STRETCH", 4)
    monkeypatch.setattr(labels, "CHILDREN", 3)
    rng = random.Random(8)
    rows = price_path(500, 5) + price_path(30, 6, "B")
    found = []
    for k in range(160):
        s, i, ts, _, _, c, _ = rng.choice(rows)
        bottom = float(round(c / 10) * 10 + rng.randint(-6, 6) * 10)
        ends = rng.choice([None, ts + dt.timedelta(minutes=rng.randint(1, 300)), ts + dt.timedelta(seconds=90)])
        found.append((s, f"Z{k}", rng.choice(["demand", "supply"]), "DBR", bottom + 10 * rng.randint(1, 3), bottom, rng.random(), ts - dt.timedelta(seconds=rng.choice([0, 0, 0, 30])), ends))
    bars = spark.createDataFrame([(r[0], r[2], r[5]) for r in rows], "symbol string, ts timestamp_ntz, close double")
    z = spark.createDataFrame(found, "symbol string, zone_id string, type string, structure string, top double, bottom double, strength double, formation_ts timestamp_ntz, invalidation_ts timestamp_ntz")
    got = {(r.symbol, r.ts): r for r in labels.context(bars, z).collect()}
    assert len(got) == len(rows)
    for s, _, ts, _, _, c, _ in rows:
        r, live = got[s, ts], [x for x in found if x[0] == s and x[7] <= ts and (x[8] is None or ts < x[8])]
        for kind in ("demand", "supply"):
            mine = [x for x in live if x[2] == kind]
            assert r[f"active_{kind}_count"] == len(mine) and r[f"price_in_{kind}_zone"] == any(x[5] <= c <= x[4] for x in mine)
            if mine:
                far = lambda x: c - x[4] if kind == "demand" else x[5] - c  # noqa: E731, B023
                best = min(mine, key=lambda x: (far(x) < 0, abs(far(x)), x[7], x[1]))
                assert r[f"nearest_{kind}_strength"] == best[6] and r[f"nearest_{kind}_top"] == best[4]
            else:
                assert r[f"nearest_{kind}_strength"] is None
    assert labels.context(bars, z.where("false")).where("active_demand_count > 0").count() == 0


def test_running_values(spark):
    from barline.functions import scans

    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, rng.choice([None, *range(9)])) for k in range(400)]
    got = scans.running(spark.createDataFrame(rows, "s string, k int, v long"), ["s"], F.floor(F.col("k") / 7), ["k"], {n: (n, F.col("v")) for n in ("sum", "max", "min", "last")} | {"n": ("count", F.when(F.col("v").isNotNull(), 1))})
    held = {}
    for r in sorted(got.collect(), key=lambda r: r.k):
        v = held.setdefault(r.s, [])
        if r.v is not None:
            v.append(r.v)
        assert (r["sum"] or 0, r["max"], r["min"], r["last"], r["n"] or 0) == ((sum(v), max(v), min(v), v[-1], len(v)) if v else (0, None, None, None, 0))


def test_nearest_intervals_are_those_of_a_scan(spark, monkeypatch):
    """Ties of price and time, thin intervals, points on ends, groups without intervals."""
    from barline.operators import nearest

    monkeypatch.setattr(history, "FAN", 4)
    rng = random.Random(12)
    when = lambda: START + dt.timedelta(minutes=rng.randint(0, 400))
    held = []
    for k in range(150):
        bottom = float(rng.randint(0, 300))
        held.append((rng.choice("ab"), f"H{k:03}", bottom + rng.choice([0.0, 1.0, 2.0, 9.0, 25.0]), bottom, when()))
    asked = []
    for k in range(250):
        low = float(rng.randint(-20, 320)) + rng.choice([0.0, 0.5])
        high = low + rng.choice([1.0, 4.0, 20.0])
        asked.append((rng.choice("aabbc"), k, (low + high) / 2, low, high, when()))
    got = nearest.nearest(spark.createDataFrame(asked, "group string, key long, at double, low double, high double, upto timestamp_ntz"), spark.createDataFrame(held, "group string, id string, top double, bottom double, formed timestamp_ntz"), 0.3)
    found = {r.key: (r.gap, r.id, r.held, r.agrees) for r in got.collect()}
    for group, key, at, low, high, upto in asked:
        mine = [h for h in held if h[0] == group and h[4] <= upto]
        near = min(((max(h[3] - at, at - h[2], 0.0), h[4], h[1]) for h in mine), default=None)
        agrees = any((min(high, h[2]) - max(low, h[3])) / (high - low) >= 0.3 for h in mine)
        assert found[key] == ((None, None, False, False) if near is None else (near[0], near[2], near[0] == 0, agrees))


def test_a_life_is_tiled_by_few_nodes(spark):
    """Whatever its length: as many nodes on a level as two parents have."""
    from barline.operators import nearest

    spans = spark.range(3000).select(F.lit(100).alias("first"), (F.col("id") + 102).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    width = F.pow(F.lit(float(nearest.CHILDREN)), "level").cast("long")
    nodes = spans.select("end", "level", F.explode(nearest.tiles(F.floor(F.col("first") / width), F.floor(F.col("end") / width))).alias("node"))
    assert nodes.groupBy("end", "level").count().agg(F.max("count")).first()[0] <= 2 * nearest.CHILDREN
    covered = nodes.select("end", F.explode(F.sequence(F.col("node") * width, (F.col("node") + 1) * width - 1)).alias("place")).groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b"))
    assert covered.where("n <> d or n <> b - a + 1 or a <> 101 or b <> end - 1").count() == 0 and covered.count() == 3000
