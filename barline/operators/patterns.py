"""Swings, price clusters, volume profiles, candlestick patterns, oscillators and movement labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import ratio
from barline.operators import trades
from barline.operators.history import Pyramid
from barline.operators.indicators import exponential, last, near, own, stretched
from barline.functions.scans import placed, running
from barline.operators.zones import BLOCK, in_blocks, overlapping


def swings(bars: DataFrame, n: int = 3) -> DataFrame:
    """Bars whose high (low) lies beyond those of n bars on both sides; the zone reaches from wick to body."""
    before, after = near().rowsBetween(-n, -1), near().rowsBetween(1, n)
    enough = (F.count("high").over(before) == n) & (F.count("high").over(after) == n)
    high = enough & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = enough & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    rows = own(stretched(placed(bars), n, n).withColumns({"swing_high": high, "swing_low": low})).where("swing_high or swing_low")
    kind = F.explode(F.filter(F.array(F.when(F.col("swing_high"), "high"), F.when(F.col("swing_low"), "low")), lambda x: x.isNotNull()))
    rows = rows.select("symbol", "ts", "open", "high", "low", "close", kind.alias("swing"))
    up = F.col("swing") == "high"
    return rows.select("symbol", "ts", "swing", F.when(up, F.col("high")).otherwise(F.least("open", "close")).alias("zone_top"), F.when(up, F.greatest("open", "close")).otherwise(F.col("low")).alias("zone_bottom"))


def price_clusters(bars: DataFrame, width: float = 50.0) -> DataFrame:
    """Bins of prices that more bars name than both neighbouring bins do, by rank of their counts."""
    prices = bars.select("symbol", F.explode(F.array("open", "high", "low", "close")).alias("price"))
    bins = prices.groupBy("symbol", F.floor(F.col("price") / width).alias("bin")).agg(F.count(F.lit(1)).alias("hits"))
    by = Window.partitionBy("symbol").orderBy("bin")
    side = lambda f: F.when(F.abs(f("bin").over(by) - F.col("bin")) == 1, f("hits").over(by)).otherwise(0)
    peaks = bins.withColumns({"left": F.coalesce(side(F.lag), F.lit(0)), "right": F.coalesce(side(F.lead), F.lit(0))}).where("hits > left and hits > right")
    return peaks.select("symbol", "bin", "hits", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("hits"), "bin")).cast("long").alias("density_rank"))


def cluster_zones(bars: DataFrame, width: float = 50.0) -> DataFrame:
    """Zones around the peaks of `price_clusters`, as wide as a symbol's mean range, joined where they overlap, by rank of their hits. Rows are peaks, not bars."""
    reach = bars.groupBy("symbol").agg(F.avg(F.col("high") - F.col("low")).alias("reach"))
    middle = (F.col("bin") + 0.5) * width
    around = price_clusters(bars, width).join(reach, "symbol").select("symbol", "hits", (middle - F.col("reach") / 2).alias("bottom"), (middle + F.col("reach") / 2).alias("top"))
    by = Window.partitionBy("symbol").orderBy("bottom")
    fresh = F.when(F.col("bottom") <= F.max("top").over(by.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    joined = around.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(by)).groupBy("symbol", "island")
    found = joined.agg(F.round(F.min("bottom"), 4).alias("bottom"), F.round(F.max("top"), 4).alias("top"), F.count(F.lit(1)).alias("peaks"), F.sum("hits").alias("hits"))
    return found.select("symbol", "bottom", "top", "peaks", "hits", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("hits"), "bottom")).cast("long").alias("density_rank"))


def volume_profile(bars: DataFrame, width: float = 50.0) -> DataFrame:
    """Each bar's volume spread evenly over the bins of its range; poc marks a symbol's fullest bin, hvn bins fuller and lvn
    bins emptier than both neighbours (an unvisited neighbour is empty and no trough's)."""
    first, end = F.floor(F.col("low") / width), F.floor(F.col("high") / width)
    spread = bars.select("symbol", F.explode(F.sequence(first, end)).alias("bin"), (F.col("volume") / (end - first + 1)).alias("part"))
    bins = spread.groupBy("symbol", "bin").agg(F.round(F.sum("part"), 6).alias("volume"))
    best = bins.groupBy("symbol").agg(F.max_by("bin", F.struct("volume", -F.col("bin"))).alias("best"))
    by = Window.partitionBy("symbol").orderBy("bin")
    beside = lambda f: F.when(F.abs(f("bin").over(by) - F.col("bin")) == 1, f("volume").over(by))
    marked = bins.withColumns({"left": beside(F.lag), "right": beside(F.lead)})
    high = (F.col("volume") > F.coalesce("left", F.lit(0.0))) & (F.col("volume") > F.coalesce("right", F.lit(0.0)))
    low = F.coalesce((F.col("volume") < F.col("left")) & (F.col("volume") < F.col("right")), F.lit(False))
    return marked.join(best, "symbol").select("symbol", "bin", "volume", (F.col("bin") == F.col("best")).alias("poc"), high.alias("hvn"), low.alias("lvn"))


#: The patterns by name, as conditions over a bar (o, h, l, c, its body, span, upper and lower wick: up, down), the one before (o1, ...)
#: and the one before that (o2, ...). A long body takes half of its range at least, a small one three tenths of the first bar's body at most.
PATTERNS = {
    "hammer": "span > 0 and down >= 2 * body and up <= 0.3 * body and body > 0",
    "inverted_hammer": "span > 0 and up >= 2 * body and down <= 0.3 * body and body > 0 and c1 < o1",
    "shooting_star": "span > 0 and up >= 2 * body and down <= 0.3 * body and body > 0",
    "doji": "span > 0 and body <= 0.1 * span",
    "dragonfly_doji": "span > 0 and body <= 0.1 * span and up <= 0.1 * span and down >= 0.6 * span",
    "gravestone_doji": "span > 0 and body <= 0.1 * span and down <= 0.1 * span and up >= 0.6 * span",
    "spinning_top": "span > 0 and body > 0.1 * span and body <= 0.3 * span and up >= 0.2 * span and down >= 0.2 * span",
    "inside_bar": "h < h1 and l > l1",
    "outside_bar": "h > h1 and l < l1",
    "bullish_engulfing": "c1 < o1 and c > o and o <= c1 and c >= o1",
    "bearish_engulfing": "c1 > o1 and c < o and o >= c1 and c <= o1",
    "bullish_harami": "c1 < o1 and c > o and o > c1 and c < o1 and body <= 0.5 * body1 and body1 >= 0.5 * span1",
    "bearish_harami": "c1 > o1 and c < o and o < c1 and c > o1 and body <= 0.5 * body1 and body1 >= 0.5 * span1",
    "piercing_line": "c1 < o1 and body1 >= 0.5 * span1 and c > o and o < l1 and c > (o1 + c1) / 2 and c < o1",
    "dark_cloud_cover": "c1 > o1 and body1 >= 0.5 * span1 and c < o and o > h1 and c < (o1 + c1) / 2 and c > o1",
    "morning_star": "c2 < o2 and body2 >= 0.5 * span2 and body1 <= 0.3 * body2 and c > o and c > (o2 + c2) / 2",
    "evening_star": "c2 > o2 and body2 >= 0.5 * span2 and body1 <= 0.3 * body2 and c < o and c < (o2 + c2) / 2",
    "three_white_soldiers": "c2 > o2 and c1 > o1 and c > o and o1 >= o2 and o1 <= c2 and o >= o1 and o <= c1 and c1 > c2 and c > c1 and up <= 0.3 * body",
    "three_black_crows": "c2 < o2 and c1 < o1 and c < o and o1 <= o2 and o1 >= c2 and o <= o1 and o >= c1 and c1 < c2 and c < c1 and down <= 0.3 * body",
}


def candle_patterns(bars: DataFrame) -> DataFrame:
    """Bars of one of the PATTERNS at least, a flag (0 or 1) for each; a pattern of several bars is flagged on its last one."""
    given = bars if "idx" in bars.columns else placed(bars)
    b = stretched(given.select("symbol", "ts", "idx", *(F.col(x).alias(x[0]) for x in ("open", "high", "low", "close"))), 2)
    b = own(b.withColumns({f"{x}{k}": F.lag(x, k).over(near()) for k in (1, 2) for x in "ohlc"}))
    b = b.withColumns({f"body{k}": F.abs(F.col(f"c{k}") - F.col(f"o{k}")) for k in ("", 1, 2)} | {f"span{k}": F.col(f"h{k}") - F.col(f"l{k}") for k in ("", 1, 2)})
    b = b.withColumns({"up": F.col("h") - F.greatest("o", "c"), "down": F.least("o", "c") - F.col("l")})
    flags = {n: F.coalesce(F.expr(x), F.lit(False)).cast("int") for n, x in PATTERNS.items()}
    return b.select("symbol", "ts", *(x.alias(n) for n, x in flags.items())).where(" + ".join(PATTERNS) + " > 0")


def oscillators(bars: DataFrame) -> DataFrame:
    """MACD with its signal, RSI, stochastic %K, rate of change, Bollinger width, on-balance volume and ADX."""
    before = lambda c, k=1: F.lag(c, k).over(near())
    mean, dev = F.avg("close").over(last(20)), F.stddev_pop("close").over(last(20))
    b = stretched(bars, 20).withColumns({"change": F.col("close") - before("close"), "high1": before("high"), "low1": before("low"), "close10": before("close", 10), "mean": mean, "dev": dev, "top": F.max("high").over(last(14)), "bottom": F.min("low").over(last(14))})
    change, up, down = F.col("change"), F.col("high") - F.col("high1"), F.col("low1") - F.col("low")
    b = own(b).withColumns({"gain": F.greatest(change, F.lit(0.0)), "loss": F.greatest(-change, F.lit(0.0)), "plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    b = exponential(b, {"e12": ("close", 2 / 13, 1), "e26": ("close", 2 / 27, 1), "ag": ("gain", 1 / 14, 15), "al": ("loss", 1 / 14, 15), "ap": ("plus", 1 / 14, 14), "am": ("minus", 1 / 14, 14)})
    b = b.withColumns({"macd": F.col("e12") - F.col("e26"), "dx": 100 * F.abs(F.col("ap") - F.col("am")) / F.nullif(F.col("ap") + F.col("am"), F.lit(0.0))})
    b = exponential(b, {"signal": ("macd", 0.2, 1), "adx": ("dx", 1 / 14, 28)})
    b = running(b, ["symbol"], F.floor(F.col("idx") / 4096), ["idx"], {"obv": ("sum", F.signum(change) * F.col("volume"))})
    low, top, obv = F.col("bottom"), F.col("top"), F.col("obv")
    return b.select(
        "symbol",
        "ts",
        F.round("macd", 3).alias("macd"),
        F.round("signal", 3).alias("macd_signal"),
        F.round(100 - 100 / (1 + ratio(F.col("ag"), F.col("al"))), 3).alias("rsi"),
        F.round(100 * ratio(F.col("close") - low, top - low), 3).alias("stochastic_k"),
        F.round(100 * ratio(F.col("close") - F.col("close10"), F.col("close10")), 4).alias("roc10"),
        F.round(4 * ratio(F.col("dev"), F.col("mean")), 5).alias("bollinger_width"),
        F.round(F.coalesce(obv, F.lit(0.0)), 0).alias("obv"),
        F.round("adx", 2).alias("adx"),
    )


def movement_labels(bars: DataFrame, ahead: int = 10, r: float = 1.0) -> DataFrame:
    """What the next bars do from a close: rise or fall by r ATRs first, both, or stay within (consolidation)."""
    after = near().rowsBetween(1, ahead)
    rise = F.max("high").over(after) - F.col("close") >= r * F.col("atr")
    fall = F.col("close") - F.min("low").over(after) >= r * F.col("atr")
    full = F.count(F.lit(1)).over(after) == ahead
    rows = own(stretched(bars, 0, ahead).withColumns({"rise": rise, "fall": fall, "full": full})).where("atr is not null and full")
    label = F.when(F.col("rise") & F.col("fall"), "both").when(F.col("rise"), "breakout_up").when(F.col("fall"), "breakout_down").otherwise("consolidation")
    return rows.select("symbol", "ts", label.alias("movement"))


def zone_reactions(zones: DataFrame, bars: DataFrame, n: int = 15, r: float = 1.5, w: float = 0.5, m: int = 5) -> DataFrame:
    """What price does at a zone: symbol, zone_id, type, entered_ts, reaction.

    From the first bar after formation that overlaps the zone, in its ATR: `reversal` if price moves r ATRs away from the near line within
    n bars before it closes w ATRs beyond the far line; else, once it closes so far beyond, `false_breakout` if within m bars it closes inside again
    and moves r ATRs away, `breakout` if not; `consolidation` if neither happens within n bars. Zones without n + m bars after that bar are left out.
    """
    z = zones.select("symbol", "zone_id", "type", "top", "bottom", "formation_idx")
    tree = Pyramid(bars.where("atr > 0"))
    asked = z.withColumn("after", F.col("formation_idx").cast("long")).drop("formation_idx")
    first = tree.first(asked, overlapping, exact=False).select("symbol", "zone_id", F.col("at").alias("enter"), F.col("bar_ts").alias("entered_ts"), F.col("atr").alias("unit"))
    last = F.floor((F.col("enter") + n + m) / BLOCK)
    ahead = z.join(first, ["symbol", "zone_id"]).withColumn("block", F.explode(F.sequence(F.floor(F.col("enter") / BLOCK), last))).join(in_blocks(bars), ["symbol", "block"]).withColumn("k", F.col("at") - F.col("enter")).where(F.col("k").between(0, n + m))
    long = F.col("type") == "demand"
    away = F.when(long, F.col("high") >= F.col("top") + r * F.col("unit")).otherwise(F.col("low") <= F.col("bottom") - r * F.col("unit"))
    beyond = F.when(long, F.col("close") < F.col("bottom") - w * F.col("unit")).otherwise(F.col("close") > F.col("top") + w * F.col("unit"))
    back = F.col("close").between(F.col("bottom"), F.col("top"))
    k = F.col("k")
    marks = ahead.withColumns({"away": away, "beyond": beyond, "back": back})
    ends = marks.groupBy("symbol", "zone_id", "type", "entered_ts").agg(F.max(k).alias("seen"), F.min(F.when(F.col("away") & (k >= 1) & (k <= n), k)).alias("a"), F.min(F.when(F.col("beyond") & (k <= n), k)).alias("b"))
    ends = ends.where(F.col("seen") == n + m)
    later = marks.join(ends.select("symbol", "zone_id", "b").where("b is not null"), ["symbol", "zone_id"]).where((k > F.col("b")) & (k <= F.col("b") + m))
    again = later.groupBy("symbol", "zone_id").agg(F.bool_or("back").alias("inside"), F.bool_or("away").alias("away"))
    out = ends.join(again, ["symbol", "zone_id"], "left")
    reaction = F.when(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b"))), "reversal").when(F.col("b").isNull(), "consolidation").when(F.coalesce(F.col("inside") & F.col("away"), F.lit(False)), "false_breakout").otherwise("breakout")
    return out.select("symbol", "zone_id", "type", "entered_ts", reaction.alias("reaction"))


def merged_ranges(zones: DataFrame, atrs: float = 1.0) -> DataFrame:
    """Price ranges by symbol and type after joining those that overlap or lie within so many ATRs: gaps and islands."""
    by = Window.partitionBy("symbol", "type").orderBy("bottom", "top")
    reach = F.max(F.col("top") + atrs * F.col("avg_atr")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    z = zones.withColumn("new", F.coalesce((F.col("bottom") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by))
    return z.groupBy("symbol", "type", "island").agg(F.min("bottom").alias("bottom"), F.max("top").alias("top"), F.count(F.lit(1)).alias("zones"))


def baselines(zones: DataFrame, bars: DataFrame, reward: float = 2.0, max_hold: int = 20, seed: int = 42) -> DataFrame:
    """Three baselines in risk units, a row for each trade: `always_reversal` trades every zone at its first close inside; `random_entry` the same
    zones from a bar that a hash chooses among the ten after it; `indicator` hammers and shooting stars alone, with a stop one ATR away.
    """
    every = trades.simulate_r(zones, bars, reward, max_hold)
    entered = every.select("symbol", "zone_id", F.col("entry_ts").alias("ts")).join(bars.select("symbol", "ts", F.col("idx").alias("fill_idx")), ["symbol", "ts"])
    delay = 1 + F.conv(F.left(F.md5(F.concat_ws(":", "symbol", "zone_id", F.lit(seed)).cast("binary")), F.lit(6)), 16, 10).cast("long") % 10
    later = entered.select("symbol", "zone_id", (F.col("fill_idx") + delay).alias("fill_idx")).join(bars.select("symbol", F.col("idx").alias("fill_idx"), F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price")), ["symbol", "fill_idx"])
    side = F.when(F.col("type") == "demand", 1.0).otherwise(-1.0)
    wide = F.abs(F.col("proximal") - F.col("distal"))
    random = zones.join(later, ["symbol", "zone_id"]).withColumn("distal", F.col("entry_price") - side * wide).withColumn("proximal", F.col("entry_price"))
    marked = candle_patterns(bars).where("hammer = 1 or shooting_star = 1").select("symbol", "ts", F.when(F.col("hammer") == 1, "demand").otherwise("supply").alias("type"))
    signals = marked.join(bars.select("symbol", "ts", F.col("idx").alias("fill_idx"), "close", "atr"), ["symbol", "ts"]).where("atr > 0")
    signals = signals.select("symbol", F.concat(F.lit("S"), F.col("fill_idx")).alias("zone_id"), "type", F.lit(None).cast("string").alias("structure"), F.col("ts").alias("formation_ts"), "fill_idx", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"), F.col("close").alias("proximal"), (F.col("close") - side * F.col("atr")).alias("distal"))
    exits = lambda rows: trades.exits_r(rows, bars, reward, max_hold)
    named = lambda rows, name: rows.select(F.lit(name).alias("baseline"), "symbol", "zone_id", "type", "entry_ts", "outcome", "r_multiple")
    return named(every, "always_reversal").unionByName(named(exits(random), "random_entry")).unionByName(named(exits(signals), "indicator"))


def buy_and_hold(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.round(100 * (F.max_by("close", "ts") / F.min_by("open", "ts") - 1), 4).alias("return_pct"), F.count(F.lit(1)).alias("bars"))
