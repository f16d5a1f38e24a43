"""Trades at zones, and the equity they compound to."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.config import TradeConfig
from barline.operators.history import Pyramid
from barline.operators.zones import BLOCK, closing_inside, in_blocks
from barline.sources.shared import written


def is_long():
    return F.col("type") == "demand"


def eligible(zones: DataFrame, t: TradeConfig = TradeConfig()) -> DataFrame:
    """Zones of wanted structures whose strength lies within the bounds, ends included; null strength fails a bound."""
    out = zones.where(F.upper("structure").isin(*t.structures))
    if "strength_pit" in zones.columns and (t.min_strength is not None or t.max_strength is not None):
        low, high = (-1e308 if t.min_strength is None else t.min_strength), (1e308 if t.max_strength is None else t.max_strength)
        out = out.where(F.col("strength_pit").between(low, high))
    return out


def entries(zones: DataFrame, bars: DataFrame, t: TradeConfig = TradeConfig(), strict: bool = False) -> DataFrame:
    """Adds fill_idx, entry_ts, fill_atr, entry_price of zones that fill.

    Over the bars after formation (with `strict` after the leg that confirms the zone): a bar beyond the distal line ends the zone, before
    anything else; the first touch (with `confirm` a close inside) opens it; the first bar from there on that reaches the proximal line
    fills, at that line worsened by slippage. All three are first hits in the pyramid of bars.
    """
    tree, keys = Pyramid(bars), ["symbol", "zone_id"]
    z = zones.select(*keys, "type", "top", "bottom", "proximal", "distal", F.col("leg_end_idx" if strict else "formation_idx").cast("long").alias("after"))
    broken = F.when(is_long(), F.col("low") < F.col("distal")).otherwise(F.col("high") > F.col("distal"))
    touched = F.when(is_long(), F.col("low") <= F.col("top")).otherwise(F.col("high") >= F.col("bottom"))
    if t.confirm:
        ends = tree.first(z, lambda: broken).select(*keys, F.col("at").alias("before"))
        z = written(z.join(ends, keys, "left"), "ends")
        opened = tree.first(z, closing_inside, exact=False).select(*keys, F.col("at").alias("touch"))
        z = z.join(opened, keys)
    else:
        both = tree.first(z.withColumn("what", F.explode(F.array(F.lit("broken"), F.lit("touched")))), lambda: F.when(F.col("what") == "broken", broken).otherwise(touched))
        both = both.groupBy(*keys).agg(F.min(F.when(F.col("what") == "broken", F.col("at"))).alias("before"), F.min(F.when(F.col("what") == "touched", F.col("at"))).alias("touch"))
        z = z.join(both.where(F.col("touch").isNotNull() & (F.col("before").isNull() | (F.col("touch") < F.col("before")))), keys)
    z = written(z.withColumn("after", F.col("touch") - 1).drop("touch"), "touched")
    fills = tree.first(z, lambda: F.when(is_long(), F.col("high") >= F.col("proximal")).otherwise(F.col("low") <= F.col("proximal")))
    first = fills.where(F.col("before").isNull() | (F.col("at") < F.col("before")))
    got = zones.join(first.select(*keys, F.col("at").alias("fill_idx"), F.col("bar_ts").alias("entry_ts"), F.col("atr").alias("fill_atr")), keys)
    worse = F.when(is_long(), 1 + t.slippage).otherwise(1 - t.slippage)
    return got.withColumn("entry_price", F.col("proximal") * worse)


def _planned(filled: DataFrame, t: TradeConfig) -> DataFrame:
    side = F.when(is_long(), 1.0).otherwise(-1.0)
    stop = F.col("entry_price") - side * t.stop_atr * F.col("fill_atr") if t.stop_atr > 0 else F.col("distal")
    out = filled.withColumns({"side": side, "stop_price": stop}).withColumn("risk", F.abs(F.col("entry_price") - F.col("stop_price"))).where("risk > 0")
    return out.withColumn("target_price", F.col("entry_price") + F.col("side") * t.reward * F.col("risk"))


def _held(planned: DataFrame, bars: DataFrame, t: TradeConfig) -> DataFrame:
    """The bars of each trade: hold 0 is the one after the fill, up to max_hold, on which it times out."""
    block = lambda c: F.floor(c / BLOCK)
    keep = planned.select("symbol", "zone_id", "type", "side", "fill_idx", "entry_price", "stop_price", "target_price", "risk")
    keep = keep.withColumn("block", F.explode(F.sequence(block(F.col("fill_idx") + 1), block(F.col("fill_idx") + t.max_hold + 1))))
    rows = keep.join(in_blocks(bars), ["symbol", "block"]).withColumn("hold", F.col("at") - F.col("fill_idx") - 1).where(F.col("hold").between(0, t.max_hold))
    # worst and best price of the bar as the trade sees them
    return rows.withColumns({"worst": F.when(is_long(), F.col("low")).otherwise(F.col("high")) * F.col("side"), "best": F.when(is_long(), F.col("high")).otherwise(F.col("low")) * F.col("side")})


def simulate(zones: DataFrame, bars: DataFrame, t: TradeConfig = TradeConfig(), strict: bool = False) -> DataFrame:
    """Trades of the eligible zones: entry, exit, outcome (win, loss, trail_win, timeout), hold_candles, r_multiple. Money comes later
    (`equity`), as no outcome depends on it. Trades still open when the data end are left out.

    Within a bar the stop counts before the target (after it with target_first). A trade that lives to hold = max_hold ends there at
    the close.
    """
    planned = _planned(entries(eligible(zones, t), bars, t, strict), t)
    rows = _held(planned, bars, t)
    s, early = F.col("side"), F.col("hold") < t.max_hold
    point = F.struct("hold", "bar_ts", "close")
    stop = F.min_by(point, F.when(early & (F.col("worst") <= s * F.col("stop_price")), F.col("hold")))
    out_of_time = F.max_by(point, F.when(F.col("hold") == t.max_hold, F.col("hold")))
    keys = ["symbol", "zone_id"]
    if not t.trail:
        target = F.min_by(point, F.when(early & (F.col("best") >= s * F.col("target_price")), F.col("hold")))
        ends = rows.groupBy(*keys).agg(stop.alias("s"), target.alias("w"), out_of_time.alias("t"))
        win_first = F.col("w.hold").isNotNull() & (F.col("s.hold").isNull() | ((F.col("w.hold") <= F.col("s.hold")) if t.target_first else (F.col("w.hold") < F.col("s.hold"))))
        ends = ends.withColumn("outcome", F.when(win_first, "win").when(F.col("s.hold").isNotNull(), "loss").when(F.col("t.hold").isNotNull(), "timeout"))
        at = F.when(win_first, F.col("w")).when(F.col("s.hold").isNotNull(), F.col("s")).otherwise(F.col("t"))
        ends = ends.withColumn("at", at).select(*keys, "outcome", "at", F.lit(None).cast("double").alias("trail_stop"))
        price = F.when(F.col("outcome") == "win", F.col("target_price")).when(F.col("outcome") == "loss", F.col("stop_price")).otherwise(F.col("at.close"))
    else:
        ends = _trailed(rows, t, stop, out_of_time, point)
        price = F.when(F.col("outcome") == "loss", F.col("stop_price")).when(F.col("outcome") == "trail_win", F.col("trail_stop")).otherwise(F.col("at.close"))
    done = planned.join(ends.where("outcome is not null"), keys).withColumn("exit_price", price)
    hold = F.col("at.hold") + (F.when((F.col("outcome") == "trail_win") & F.col("same_bar"), 1).otherwise(0) if t.trail else F.lit(0))
    return done.select(
        "symbol",
        "zone_id",
        "type",
        "structure",
        "formation_ts",
        "formation_idx",
        "entry_ts",
        F.col("at.bar_ts").alias("exit_ts"),
        "entry_price",
        "stop_price",
        "target_price",
        "exit_price",
        "risk",
        "side",
        "outcome",
        hold.cast("long").alias("hold_candles"),
        F.round(F.col("side") * (F.col("exit_price") - F.col("entry_price")) / F.col("risk"), 4).alias("r_multiple"),
    )


def _trailed(rows: DataFrame, t: TradeConfig, stop, out_of_time, point) -> DataFrame:
    """Exits with a trailing stop: from the bar that reaches the trigger the stop follows the running best price and only tightens. Running
    maxima say all of it, so there is no fold.
    """
    keys, s = ["symbol", "zone_id"], F.col("side")
    trigger = s * F.col("entry_price") + t.trail_trigger * F.col("risk")
    early = F.col("hold") < t.max_hold
    first = rows.groupBy(*keys).agg(stop.alias("s"), F.min(F.when(early & (F.col("best") >= trigger), F.col("hold"))).alias("on"), out_of_time.alias("t"))
    live = rows.join(first.where(F.col("on").isNotNull() & (F.col("s.hold").isNull() | (F.col("on") < F.col("s.hold")))).select(*keys, "on"), keys).where((F.col("hold") >= F.col("on")) & early)
    by = Window.partitionBy(*keys).orderBy("hold").rowsBetween(Window.unboundedPreceding, 0)
    moves = (F.col("atr") > 0) | (F.col("hold") == F.col("on"))
    live = live.withColumn("run", F.max(F.when(moves, F.col("best"))).over(by))
    live = live.withColumn("mark", F.when(F.col("atr") > 0, F.col("run") - t.trail_atr * F.col("atr")))
    floor = F.when((F.col("hold") == F.col("on")) & (F.col("atr") > 0), trigger - t.trail_floor * F.col("atr"))
    live = live.withColumn("level", F.greatest(s * F.col("stop_price"), F.max(F.greatest("mark", floor)).over(by)))
    hit = live.where(F.col("worst") <= F.col("level")).groupBy(*keys).agg(F.min_by(F.struct("hold", "bar_ts", "close", (s * F.col("level")).alias("level"), (F.col("hold") == F.col("on")).alias("same")), "hold").alias("x"))
    ends = first.join(hit, keys, "left")
    lost = F.col("s.hold").isNotNull() & (F.col("on").isNull() | (F.col("s.hold") <= F.col("on")))
    outcome = F.when(lost, "loss").when(F.col("x.hold").isNotNull(), "trail_win").when(F.col("t.hold").isNotNull(), "timeout")
    at = F.when(lost, F.col("s")).when(F.col("x.hold").isNotNull(), F.struct("x.hold", "x.bar_ts", "x.close")).otherwise(F.col("t"))
    return ends.select(*keys, outcome.alias("outcome"), at.alias("at"), F.col("x.level").alias("trail_stop"), F.coalesce("x.same", F.lit(False)).alias("same_bar"))


def equity(trades: DataFrame, t: TradeConfig = TradeConfig()) -> DataFrame:
    """Adds seq, capital_at_entry, shares, gross_pnl, net_pnl, equity_after_trade. Capital compounds in order of formation: each symbol's
    trades are one sorted pass that hands on one number, as every amount is rounded before it compounds.
    """
    order = Window.partitionBy("symbol").orderBy("formation_ts", "zone_id")
    numbered = trades.withColumn("seq", F.row_number().over(order))
    schema = "symbol string, seq int, capital_at_entry double, shares double, gross_pnl double, net_pnl double, equity_after_trade double"

    def compounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, capital = None, t.capital  # a symbol's rows lie together in order, over one batch or more
        for batch in batches:
            rows = []
            for own, seq, risk, move in zip(batch.symbol, batch.seq, batch.risk, batch.move, strict=True):
                if own != symbol:
                    symbol, capital = own, t.capital
                before, shares = capital, capital * t.risk / risk
                gross, net = cents(move * shares), cents(move * shares - 2 * t.commission)
                capital = max(before + net, 0.0)
                rows.append((own, seq, before, round(shares, 4), gross, net, cents(capital)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    sorted_rows = numbered.select("symbol", "seq", "risk", (F.col("side") * (F.col("exit_price") - F.col("entry_price"))).alias("move")).repartition("symbol").sortWithinPartitions("symbol", "seq")
    return numbered.join(sorted_rows.mapInPandas(compounded, schema), ["symbol", "seq"])


def cents(x: float) -> float:
    """x to two digits, half up on its shortest decimal form, as Spark's round does."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def modes(zones: DataFrame, bars: DataFrame, least_prob: float, reward: float = 2.0, max_hold: int = 60) -> DataFrame:
    """R trades of all zones (`baseline`) and of those that a model's ml_prob passes (`filtered`; left out where no zone has one or
    least_prob is 0), one above the other, with ml_prob.
    """
    prob = zones.select("symbol", "zone_id", "ml_prob")
    every = simulate_r(zones, bars, reward, max_hold).join(prob, ["symbol", "zone_id"])
    if least_prob <= 0:
        return every.withColumn("mode", F.lit("baseline"))
    scored = every.withColumn("scored", F.max(F.col("ml_prob").isNotNull().cast("int")).over(Window.partitionBy("symbol")) == 1)
    passes = F.col("scored") & (F.col("ml_prob").isNull() | (F.col("ml_prob") >= least_prob))
    return scored.withColumn("mode", F.explode(F.when(passes, F.array(F.lit("baseline"), F.lit("filtered"))).otherwise(F.array(F.lit("baseline"))))).drop("scored")


def simulate_r(zones: DataFrame, bars: DataFrame, reward: float = 2.0, max_hold: int = 60, least_prob: float = 0.0) -> DataFrame:
    """Trades counted in risk units: entry on the first close inside the zone, at the proximal line; trades open at the end stay, as `open`.
    Zones with an ml_prob below least_prob are left out, null passes.
    """
    if least_prob > 0:
        zones = zones.where(F.col("ml_prob").isNull() | (F.col("ml_prob") >= least_prob))
    z = zones.select("symbol", "zone_id", "top", "bottom", F.col("formation_idx").cast("long").alias("after"))
    first = Pyramid(bars).first(z, closing_inside, exact=False).select("symbol", "zone_id", F.col("at").alias("fill_idx"), F.col("bar_ts").alias("entry_ts"))
    return exits_r(zones.join(first, ["symbol", "zone_id"]).withColumn("entry_price", F.col("proximal")), bars, reward, max_hold)


def exits_r(filled: DataFrame, bars: DataFrame, reward: float = 2.0, max_hold: int = 60) -> DataFrame:
    """The trades of filled zones (with fill_idx, entry_ts, entry_price) in risk units: stop at the distal line, first within a bar, then target,
    timeout at max_hold, else `open`.
    """
    t = TradeConfig(reward=reward, max_hold=max_hold)
    planned = _planned(filled.withColumn("fill_atr", F.lit(None).cast("double")), t)
    rows = _held(planned, bars, t)
    early, s, point = F.col("hold") < max_hold, F.col("side"), F.struct("hold", "bar_ts", "close")
    ends = rows.groupBy("symbol", "zone_id").agg(
        F.min_by(point, F.when(early & (F.col("worst") <= s * F.col("stop_price")), F.col("hold"))).alias("s"),
        F.min_by(point, F.when(early & (F.col("best") >= s * F.col("target_price")), F.col("hold"))).alias("w"),
        F.max_by(point, F.when(F.col("hold") == max_hold, F.col("hold"))).alias("t"),
    )
    done = planned.join(ends, ["symbol", "zone_id"], "left")
    won = F.col("w.hold").isNotNull() & (F.col("s.hold").isNull() | (F.col("w.hold") < F.col("s.hold")))
    outcome = F.when(won, "win").when(F.col("s.hold").isNotNull(), "loss").when(F.col("t.hold").isNotNull(), "timeout").otherwise("open")
    at = F.when(won, F.col("w")).when(F.col("s.hold").isNotNull(), F.col("s")).otherwise(F.col("t"))
    price = F.when(won, F.col("target_price")).when(F.col("s.hold").isNotNull(), F.col("stop_price")).otherwise(F.col("t.close"))
    done = done.withColumns({"outcome": outcome, "exit_price": price, "exit_ts": at.bar_ts, "hold_candles": at.hold})
    return done.select("symbol", "zone_id", "type", "structure", "formation_ts", "entry_ts", "exit_ts", "entry_price", "stop_price", "target_price", "exit_price", "outcome", "hold_candles", F.round(s * (F.col("exit_price") - F.col("entry_price")) / F.col("risk"), 4).alias("r_multiple"))
