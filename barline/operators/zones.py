"""Supply and demand zones from base and leg structure, their scores, merging and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.config import ZoneConfig
from barline.functions.expr import clip, peak, ratio, weighted
from barline.operators.history import Pyramid
from barline.operators.indicators import near, own, stretched
from barline.functions.scans import running
from barline.sources.shared import written

#: Bars of a block by which bars are met.
BLOCK = 256
REQUIRED = ("open", "high", "low", "close", "atr")


def require(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> None:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")


def base_candles(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds is_base: a bar that is small against its ATR in range and body; false while ATR warms up or is 0."""
    small = (F.col("high") - F.col("low") <= z.base_range * F.col("atr")) & (F.abs(F.col("close") - F.col("open")) <= z.base_body * F.col("atr"))
    return bars.withColumn("is_base", F.coalesce((F.col("atr") > 0) & small, F.lit(False)))


def _at(c: str, k: int) -> Column:
    """c of the bar k later (earlier if negative)."""
    return F.col(c) if k == 0 else (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(near())


def bases(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds for bars that end a base: n (bars in it, the widest that is tight enough), top, bottom, avg_atr and what scores need;
    null n elsewhere. No fold: a base is at most z.max_base bars long, so each length is a projection over lagged columns.
    """
    return own(_bases(stretched(_checked(bars), z.max_base), z))


def _checked(bars: DataFrame) -> DataFrame:
    require(bars)
    return bars


def _bases(bars: DataFrame, z: ZoneConfig) -> DataFrame:
    b = base_candles(bars, z)
    found: dict[int, dict[str, Column]] = {}
    for k in range(z.max_base, z.min_base - 1, -1):
        each = lambda c, k=k: [_at(c, -j) for j in range(k)]
        most = lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0]
        least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0]
        total = lambda xs: sum(xs[1:], xs[0])
        bodies = [F.abs(c - o) for o, c in zip(each("open"), each("close"), strict=True)]
        heard = [F.when(v > 0, v) for v in each("volume_ratio")]
        run = F.lit(True)
        for x in each("is_base"):
            run = run & F.coalesce(x, F.lit(False))
        top, bottom, atr = most(each("high")), least(each("low")), total(each("atr")) / k
        found[k] = {
            "ok": run & (top - bottom <= z.base_cluster * atr),
            "top": top,
            "bottom": bottom,
            "avg_atr": atr,
            "body_top": most([F.greatest(o, c) for o, c in zip(each("open"), each("close"), strict=True)]),
            "body_bottom": least([F.least(o, c) for o, c in zip(each("open"), each("close"), strict=True)]),
            "wick": 1 - ratio(total(bodies), total([h - low for h, low in zip(each("high"), each("low"), strict=True)])),
            "base_volume": ratio(total([F.coalesce(v, F.lit(0.0)) for v in heard]), total([F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in heard])),
        }
    b = b.withColumns({f"ok{k}": v["ok"] for k, v in found.items()})
    pick = lambda name: F.coalesce(*(F.when(F.col(f"ok{k}"), v[name]) for k, v in found.items()))
    names = ("top", "bottom", "avg_atr", "body_top", "body_bottom", "wick", "base_volume")
    out = b.withColumns({"n": F.coalesce(*(F.when(F.col(f"ok{k}"), k) for k in found)), **{x: pick(x) for x in names}})
    return out.drop(*(f"ok{k}" for k in found))


def _where(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) that stays above df's projections: pushed below, it would repeat the leg's nested steps many times over."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(condition & (F.col("_row") >= 0)).drop("_row")


def _unrolled(b: DataFrame, z: ZoneConfig) -> DataFrame:
    """The leg's columns, one step a projection, so that expressions stay small."""
    up = F.col("up")
    b = b.withColumns({"ext": F.col("c1"), "leg_n": F.lit(1), "leg_volume": F.col("v1"), "live": F.col("c1").isNotNull()})
    for j in range(2, z.leg_max + 1):
        c = F.col(f"c{j}")
        here = F.col("live") & c.isNotNull()
        wins = here & F.when(up, c > F.col("ext")).otherwise(c < F.col("ext"))
        b = b.withColumns({"here": here, "wins": wins})
        stops = ~F.col("wins") & (F.abs(F.col("ext") - c) >= z.leg_pullback * F.col("avg_atr"))
        b = b.withColumns(
            {
                "live": F.col("here") & ~stops,
                "leg_volume": F.col("leg_volume") + F.when(F.col("here"), F.col(f"v{j}")).otherwise(0.0),
                "leg_n": F.when(F.col("wins"), j).otherwise(F.col("leg_n")),
                "ext": F.when(F.col("wins"), c).otherwise(F.col("ext")),
            }
        )
    return b.drop("here", "wins", "live", *(f"{x}{j}" for x in "cv" for j in range(1, z.leg_max + 1)))


def departures(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """The bars that end a base with a departure: those columns plus type and leg metrics (4 decimals). symbol and idx identify them."""
    deep, far = z.leg_in_lookback + z.max_base, z.leg_max + 1
    b = _bases(stretched(_checked(bars), deep, far), z)
    o, h, low, c = (_at(x, 1) for x in ("open", "high", "low", "close"))
    b = b.withColumns({"fo": o, "fh": h, "fl": low, "fc": c, "formation_ts": _at("ts", 1), "up": c >= o})
    b = b.withColumns({"first_ema200": _at("ema200", 1), "first_atr": _at("atr", 1), "departure_volume_ratio": _at("volume_ratio", 1)})
    # bars before the base, for the arrival: at most leg_in_lookback of them before at most max_base bars
    b = b.withColumns({f"{x[0]}_{j}": _at(x, -j) for x in ("open", "close") for j in range(1, deep + 1)})
    ahead = range(1, z.leg_max + 1)
    b = b.withColumns({f"c{j}": _at("close", j) for j in ahead} | {f"v{j}": F.coalesce(_at("volume_ratio", j), F.lit(0.0)) for j in ahead})
    b = _unrolled(_where(own(b), F.col("n").isNotNull() & F.col("fc").isNotNull()), z)
    span = F.col("fh") - F.col("fl")
    close_ratio = F.when(F.col("up"), F.col("fc") - F.col("fl")).otherwise(F.col("fh") - F.col("fc")) / F.nullif(span, F.lit(0.0))
    body = F.abs(F.col("fc") - F.col("fo")) / F.col("avg_atr")
    clear = F.when(F.col("up"), F.col("ext") - F.col("top")).otherwise(F.col("bottom") - F.col("ext")) / F.col("avg_atr")
    disp = F.abs(F.col("ext") - F.col("fc")) / F.col("avg_atr")
    b = _where(b, (span >= 1e-10) & (close_ratio >= z.departure_close) & (body >= z.departure_floor) & (clear >= z.leg_clear))
    return b.withColumns(
        {
            "type": F.when(F.col("up"), "demand").otherwise("supply"),
            "departure_body_atr": F.round(body, 4),
            "departure_close_ratio": F.round(close_ratio, 4),
            "leg_out_clear_atr": F.round(clear, 4),
            "leg_out_disp_atr": F.round(disp, 4),
            "leg_out_candles": F.col("leg_n"),
            "leg_out_velocity": F.round(disp / F.col("leg_n"), 4),
            "leg_out_vol_exp": F.round(F.col("leg_volume") / F.col("leg_n"), 4),
        }
    )


def arrivals(found: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds the arrival before the base: arrival (up, down or null), leg_in_* and cleanliness; the window shrinks at a series' start."""
    lb, n = z.leg_in_lookback, F.col("n")
    pick = lambda x, j: F.coalesce(*(F.when(n == k, F.col(f"{x}_{k + j}")) for k in range(z.min_base, z.max_base + 1)))
    found = found.withColumns({f"a{x}{j}": pick(x, j) for x in "oc" for j in range(lb)})
    m = sum((F.when(F.col(f"ac{j}").isNotNull(), 1).otherwise(0) for j in range(1, lb)), F.when(F.col("ac0").isNotNull(), 1).otherwise(0))
    origin = F.coalesce(*(F.col(f"ao{j}") for j in range(lb - 1, -1, -1)))
    found = found.withColumns({"m": m, "origin": origin, "net": F.col("ac0") - origin, "prior_open": F.col("ao0")})
    disp = F.abs(F.col("net")) / F.col("avg_atr")
    least = z.leg_in_min_move if z.leg_in_enabled else 0.0
    down = F.col("net") < 0
    clean = sum((F.when(F.when(down, F.col(f"ac{j}") < F.col(f"ao{j}")).otherwise(F.col(f"ac{j}") >= F.col(f"ao{j}")), 1.0).otherwise(0.0) for j in range(lb)), F.lit(0.0)) / F.col("m")
    has = F.coalesce((F.col("net") != 0) & (disp >= least), F.lit(False))
    given = lambda x: F.when(has, x)
    return found.withColumns(
        {
            "arrival": given(F.when(down, "down").otherwise("up")),
            "leg_in_disp_atr": given(F.round(disp, 4)),
            "leg_in_candles": given(F.col("m")),
            "leg_in_velocity": given(F.round(disp / F.col("m"), 4)),
            "arrival_cleanliness": given(F.round(clean, 4)),
            "origin_ok": given(F.when(down, origin > F.col("top")).otherwise(origin < F.col("bottom"))),
        }
    ).drop(*(f"a{x}{j}" for x in "oc" for j in range(lb)), "net", "m")


def raw_zones(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Zones before scores and merging: departures with arrival, structure and containment."""
    f = arrivals(departures(bars, z), z)
    out, arrived = F.col("up"), F.col("arrival")
    if z.leg_in_enabled and z.arrival_mode == "reversal":
        f = f.where(F.when(out, arrived == "down").otherwise(arrived == "up"))
        if z.arrival_origin:
            f = f.where("origin_ok")
    elif z.leg_in_enabled and z.arrival_mode == "any":
        f = f.where(arrived.isNotNull())
    came = F.when(arrived == "up", "R").when(arrived == "down", "D").otherwise(F.when(out, "D").otherwise("R"))
    f = f.withColumn("structure", F.concat(came, F.lit("B"), F.when(out, "R").otherwise("D")))
    if z.containment:
        wick = z.containment_price == "wick"
        high, low = (F.col("top"), F.col("bottom")) if wick else (F.col("body_top"), F.col("body_bottom"))
        beyond = F.when(out, high < F.col("fc")).otherwise(low > F.col("fc"))
        before = F.when(arrived == "down", high < F.col("prior_open")).when(arrived == "up", low > F.col("prior_open")).otherwise(F.lit(True))
        f = _where(f, beyond & before & F.col("prior_open").isNotNull())
    return f.withColumn("base_idx", F.col("idx")).withColumn("formation_idx", F.col("idx") + 1)


def volume_trust(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Whether a symbol's volume is to be scored: hardly any bar without it."""
    return bars.groupBy("symbol").agg((F.avg((F.coalesce("volume", F.lit(0.0)) <= 0).cast("double")) <= z.max_zero_volume).alias("volume_trusted"))


def scored_zones(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """One row for each zone with its geometry, legs and formation-time scores, as they are stored (4 decimals)."""
    f = raw_zones(bars, z).join(volume_trust(bars, z), "symbol")
    span = F.col("top") - F.col("bottom")
    side = F.when(F.col("up"), 1.0).otherwise(-1.0)
    trend = clip(0.5 + side * ratio(F.col("fc") - F.col("first_ema200"), F.col("first_atr")) / (2 * z.trend_full))
    disp_base = ratio(F.col("leg_out_disp_atr") * F.col("avg_atr"), span)
    f = f.withColumns({"trend_score": trend, "disp_base": disp_base})
    dep = 0.5 * F.least(F.col("leg_out_clear_atr") / (2 * z.leg_clear), F.lit(1.0)) + 0.3 * F.least(F.col("departure_body_atr") / (2 * z.departure_floor), F.lit(1.0)) + 0.2 * F.least(F.col("departure_close_ratio"), F.lit(1.0))
    tight = F.greatest(1 - span / F.col("avg_atr") / z.base_cluster, F.lit(0.0))
    momentum = F.least(F.col("leg_in_disp_atr") / (2 * max(z.leg_in_min_move, 0.5)), F.lit(1.0))
    came = F.when(F.lit(z.leg_in_enabled), 0.7 * momentum + 0.3 * clip(F.col("arrival_cleanliness")))
    heard = F.col("volume_trusted")
    dv, bv = F.col("departure_volume_ratio"), F.col("base_volume")
    dep_volume = F.when(heard, F.when(dv > 0, F.least(dv / 3, F.lit(1.0))).otherwise(0.5))
    base_volume = F.when(heard, F.when(bv > 0, clip(1 - (bv - z.base_volume_low) / (z.base_volume_high - z.base_volume_low))).otherwise(0.5))
    strength = weighted(
        [
            (dep, z.departure_weight),
            (tight, z.tightness_weight),
            (came, z.arrival_weight),
            (dep_volume, max(z.volume_weight - z.base_volume_weight, 0.0)),
            (base_volume, z.base_volume_weight),
            (F.col("trend_score"), z.trend_weight),
        ]
    )
    length = F.when(F.col("n") == 1, 0.4).when(F.col("n") == 2, 0.7).when(F.col("n") == 3, 0.8).otherwise(1.0)
    structure = 0.6 * length + 0.4 * F.coalesce(clip((F.col("wick") - 0.3) / 0.5), F.lit(0.5))
    legin = F.when(F.lit(z.leg_in_enabled), 0.6 * clip(F.col("leg_in_velocity") / 0.8) + 0.4 * clip(F.col("arrival_cleanliness")))
    dispb = F.when(F.col("disp_base").isNotNull(), peak(F.col("disp_base"), 1.0, 1.5, 1.5))
    grown = F.least(F.col("leg_out_vol_exp") / 1.5, F.lit(1.0))
    volume = F.when(heard, F.when(bv.isNotNull(), (grown + clip(1 - (bv - 0.7) / 0.6)) / 2).otherwise(grown))
    quality = weighted(
        [
            (structure, z.quality_base),
            (peak(F.col("leg_out_clear_atr"), 0.8, 1.5, 0.8), z.quality_leg_out),
            (legin, z.quality_leg_in),
            (dispb, z.quality_disp),
            (F.col("trend_score"), z.quality_trend),
            (volume, z.quality_volume),
        ]
    )
    f = f.withColumns({"strength": F.round(strength, 4), "quality": F.round(quality, 4)})
    f = written(_where(f, F.col("quality") >= z.min_quality), "raw_zones")
    f = running(f, ["symbol"], F.floor(F.col("base_idx") / 4096), ["base_idx"], {"number": ("count", F.lit(1))})
    r4 = lambda c: F.round(c, 4)
    return f.select(
        "symbol",
        F.format_string("Z%04d", "number").alias("zone_id"),
        "type",
        "structure",
        r4("top").alias("top"),
        r4("bottom").alias("bottom"),
        r4((F.col("top") + F.col("bottom")) / 2).alias("midpoint"),
        r4(F.when(F.col("up"), F.col("body_top")).otherwise(F.col("body_bottom"))).alias("proximal"),
        r4(F.when(F.col("up"), F.col("bottom")).otherwise(F.col("top"))).alias("distal"),
        r4(span).alias("width"),
        r4(span / F.col("avg_atr")).alias("width_atr"),
        "formation_ts",
        F.col("formation_idx").cast("long").alias("formation_idx"),
        (F.col("base_idx") - F.col("n") + 1).cast("long").alias("base_start_idx"),
        F.col("base_idx").cast("long").alias("base_end_idx"),
        F.col("ts").alias("base_end_ts"),
        F.col("n").alias("base_length"),
        r4("wick").alias("base_wick_frac"),
        r4("avg_atr").alias("avg_atr"),
        r4("base_volume").alias("base_volume_ratio"),
        "departure_body_atr",
        "departure_close_ratio",
        "leg_out_clear_atr",
        "leg_out_disp_atr",
        "leg_out_candles",
        "leg_out_velocity",
        "leg_out_vol_exp",
        r4("departure_volume_ratio").alias("departure_volume_ratio"),
        "leg_in_disp_atr",
        F.coalesce("leg_in_candles", F.lit(0)).alias("leg_in_candles"),
        "leg_in_velocity",
        "arrival_cleanliness",
        r4("disp_base").alias("disp_base_ratio"),
        r4("trend_score").alias("trend_score"),
        (F.col("trend_score") >= 0.5).alias("trend_aligned"),
        "strength",
        F.round(100 * F.col("quality"), 2).alias("quality_score"),
        (F.col("formation_idx") + F.col("leg_out_candles") - 1).cast("long").alias("leg_end_idx"),
    )


def merged(zones: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Greedy merge in order of formation: a zone joins the first kept one of its symbol and type that overlaps it by half of the
    smaller height within 60 bars, and takes its place if its quality is higher (never if z.strict). Adds merged_count.

    A fold for each symbol and type, over zones alone. Zones further apart than the gap can't meet, so each run of zones without such
    a distance is folded by itself.
    """
    by = Window.partitionBy("symbol", "type").orderBy("formation_idx", "zone_id")
    far = F.coalesce(F.col("formation_idx") - F.lag("formation_idx").over(by) > z.merge_gap, F.lit(True))
    run = zones.withColumn("far", far).withColumn("run", F.sum(F.col("far").cast("int")).over(by))
    state = "array<struct<formation_idx:bigint,zone_id:string,top:double,bottom:double,quality_score:double,n:int>>"
    item = F.struct("formation_idx", "zone_id", "top", "bottom", "quality_score")

    def hit(k: Column, x: Column) -> Column:
        overlap = F.least(k.top, x.top) - F.greatest(k.bottom, x.bottom)
        height = F.least(k.top - k.bottom, x.top - x.bottom)
        return F.coalesce((overlap > 0) & (height > 0) & (overlap >= z.merge_overlap * height) & (F.abs(k.formation_idx - x.formation_idx) <= z.merge_gap), F.lit(False))

    def entry(x: Column, n: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in ("formation_idx", "zone_id", "top", "bottom", "quality_score")), n.cast("int").alias("n"))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: hit(k, x)), True)
        better = lambda k: F.lit(False) if z.strict else x.quality_score > k.quality_score
        joined = F.transform(kept, lambda k, i: F.when(i + 1 != at, k).when(better(k), entry(x, k.n + 1)).otherwise(entry(k, k.n + 1)))
        return F.when(at > 0, joined).otherwise(F.concat(kept, F.array(entry(x, F.lit(1)))))

    folded = run.groupBy("symbol", "type", "run").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    kept = folded.select("symbol", F.explode(F.aggregate("xs", F.array().cast(state), step)).alias("k")).select("symbol", "k.zone_id", F.col("k.n").alias("merged_count"))
    return zones.join(kept, ["symbol", "zone_id"])


def in_blocks(bars: DataFrame) -> DataFrame:
    """Bars as they are met by symbol and block: at is the bar's place, bar_ts its stamp."""
    return bars.select("symbol", F.floor(F.col("idx") / BLOCK).alias("block"), F.col("idx").alias("at"), F.col("ts").alias("bar_ts"), "open", "high", "low", "close", "atr")


def lifecycle(zones: DataFrame, bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds status, test_count, last_test_ts, invalidation_ts, freshness_score.

    The first bar after formation that closes (with `wick` trades) beyond a zone ends its life; of the bars before it those that overlap the zone
    are met, and each entry into the zone is a test. Both by the pyramid, so that a zone's work grows with its tests and the logarithm of the bars.
    """
    wick, demand = z.invalidation == "wick", F.col("type") == "demand"
    tree = Pyramid(bars)
    asked = zones.select("symbol", "zone_id", "type", "top", "bottom", F.col("formation_idx").cast("long").alias("after"))
    low, high = ("low", "high") if wick else ("low_close", "high_close")
    ends = tree.first(asked, lambda: F.when(demand, F.col(low) < F.col("bottom")).otherwise(F.col(high) > F.col("top")))
    ends = ends.select("symbol", "zone_id", F.col("at").alias("before"), F.col("bar_ts").alias("invalidation_ts"))
    asked = written(asked.join(ends, ["symbol", "zone_id"], "left"), "lives")
    inside = tree.hits(asked.drop("invalidation_ts"), overlapping)
    by = Window.partitionBy("symbol", "zone_id").orderBy("at")
    tests = inside.withColumn("last", F.lag("at").over(by)).where(F.col("last").isNull() | (F.col("last") < F.col("at") - 1))
    sums = tests.groupBy("symbol", "zone_id").agg(F.count(F.lit(1)).alias("test_count"), F.max("bar_ts").alias("last_test_ts"))
    out = zones.join(asked.select("symbol", "zone_id", "invalidation_ts"), ["symbol", "zone_id"]).join(sums, ["symbol", "zone_id"], "left").withColumn("test_count", F.coalesce("test_count", F.lit(0)))
    decay = F.array(*(F.lit(x) for x in z.decay))
    status = F.when(F.col("invalidation_ts").isNotNull(), "broken").when(F.col("test_count") > 0, "tested").otherwise("active")
    return out.withColumns({"status": status, "freshness_score": F.element_at(decay, (F.least("test_count", F.lit(len(z.decay) - 1)) + 1).cast("int"))})


def overlapping() -> Column:
    """Whether a bar's range overlaps a zone's; of a block, whether one of its bars may."""
    return (F.col("low") <= F.col("top")) & (F.col("high") >= F.col("bottom"))


def closing_inside() -> Column:
    return (F.col("low_close") <= F.col("top")) & (F.col("high_close") >= F.col("bottom"))


def finished(zones: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds strength_pit (known at formation) and adjusted_strength_posthoc (after the zone's later tests)."""
    bonus = F.coalesce(F.col("htf_confluence"), F.lit(0.0)) if "htf_confluence" in zones.columns else F.lit(0.0)
    pit = F.round(F.least(F.col("quality_score") / 100 + z.strength_bonus * bonus, F.lit(1.0)), 4)
    return zones.withColumn("strength_pit", pit).withColumn("adjusted_strength_posthoc", F.round(F.least(F.col("strength_pit") * F.col("freshness_score"), F.lit(1.0)), 4))


def detect(bars: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """bars with indicators -> zones, merged, with lifecycle and final scores."""
    return finished(lifecycle(merged(scored_zones(bars, z), z), bars, z), z)


def summary(zones: DataFrame) -> DataFrame:
    return zones.groupBy("symbol", "type", "status").agg(F.count(F.lit(1)).alias("zones"), F.round(F.avg("quality_score"), 4).alias("mean_quality"), F.sum("merged_count").cast("long").alias("raw_zones"))
