"""Data quality and exploration of bars; each is one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.expr import ratio
from barline.operators.indicators import near, own, stretched
from barline.functions.scans import numbered, percentiles, placed

PRICES = ("open", "high", "low", "close", "volume")


def profile(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.datediff(F.max("ts").cast("date"), F.min("ts").cast("date")).cast("long").alias("days"))


def nulls(bars: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: nulls and their percentage."""
    one = bars.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    stacked = ", ".join(f"'{c}', {c}" for c in columns)
    return one.select("n", F.expr(f"stack({len(columns)}, {stacked}) as (column_name, n_null)")).select("column_name", "n_null", F.round(100 * ratio(F.col("n_null").cast("double"), F.col("n").cast("double")), 4).alias("pct_null"))


def integrity(bars: DataFrame) -> DataFrame:
    o, h, low, c, v = (F.col(x) for x in PRICES)
    rules = {"high_below_low": h < low, "open_above_high": o > h, "open_below_low": o < low, "close_above_high": c > h, "close_below_low": c < low, "not_positive": F.least(o, h, low, c) <= 0, "no_volume": v <= 0}
    return bars.groupBy("symbol").agg(*(F.count_if(x).alias(n) for n, x in rules.items()))


def gaps(bars: DataFrame, hours: float = 1.0) -> DataFrame:
    """How often bars are more than so many hours apart, by the gap's length."""
    apart = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(near()).cast("timestamp"))) / 3600
    return own(stretched(placed(bars), 1).withColumn("gap_hours", apart)).where(F.col("gap_hours") > hours).groupBy("symbol", "gap_hours").agg(F.count(F.lit(1)).alias("gaps"))


def duplicates(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).cast("long").alias("duplicates"))


def atr_stats(bars: DataFrame) -> DataFrame:
    pct = bars.where("atr is not null").withColumn("pct", 100 * F.col("atr") / F.col("close"))
    q, bounds = F.col("q"), percentiles(pct, ["symbol"], "pct", [0.05, 0.25, 0.5, 0.75, 0.95])
    first = lambda f, v: f("ts", F.struct(v, F.col("ts"))) if f is F.min_by else F.max_by("ts", F.struct(v, -F.col("idx")))
    return pct.groupBy("symbol").agg(F.round(F.avg("pct"), 4).alias("mean"), F.round(F.stddev_samp("pct"), 4).alias("std"), F.round(F.min("pct"), 4).alias("least"), F.round(F.max("pct"), 4).alias("most"), first(F.min_by, F.round("pct", 6)).alias("least_ts"), first(F.max_by, F.round("pct", 6)).alias("most_ts")).join(bounds, "symbol").select("symbol", "mean", "std", "least", "most", *(F.round(q[i], 4).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))), "least_ts", "most_ts")


def regimes(bars: DataFrame, window: int = 60) -> DataFrame:
    """Bars by volatility: ATR% below its quartiles, between them or above, with the mean of the last 60 at hand."""
    pct = bars.where("atr is not null").withColumn("pct", 100 * F.col("atr") / F.col("close"))
    bounds = percentiles(pct, ["symbol"], "pct", [0.25, 0.75]).select("symbol", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    by = near().rowsBetween(-(window - 1), 0)
    smooth = own(stretched(pct, window).withColumn("smooth", F.when(F.count("pct").over(by) == window, F.avg("pct").over(by))))
    regime = F.when(F.col("pct") < F.col("q1"), "low").when(F.col("pct") > F.col("q3"), "high").otherwise("normal")
    return smooth.join(bounds, "symbol").groupBy("symbol", regime.alias("regime")).agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg("smooth"), 4).alias("mean_smooth"))


def by_period(bars: DataFrame, unit: str = "day") -> DataFrame:
    pct = bars.where("atr is not null").withColumn("pct", 100 * F.col("atr") / F.col("close"))
    q = F.expr("percentile(pct, array(0.25, 0.5, 0.75))")
    return pct.groupBy("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("period")).agg(F.count(F.lit(1)).alias("bars"), *(F.round(q[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def moments(bars: DataFrame, periods: int = 252) -> DataFrame:
    """Mean, deviation, sample skewness and excess kurtosis of log returns, Jarque-Bera statistic and its p value."""
    n, g1, g2 = F.count("log_return").cast("double"), F.skewness("log_return"), F.kurtosis("log_return")
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    jb = n / 6 * (g1 * g1 + g2 * g2 / 4)
    return bars.groupBy("symbol").agg(
        F.count("log_return").alias("returns"),
        F.round(1e4 * F.avg("log_return"), 4).alias("mean_bp"),
        F.round(F.stddev_samp("log_return"), 6).alias("std"),
        F.round(F.stddev_samp("log_return") * F.sqrt(F.lit(float(periods))), 5).alias("annual_std"),
        F.round(skew, 4).alias("skew"),
        F.round(kurt, 4).alias("excess_kurtosis"),
        F.round(jb, 2).alias("jarque_bera"),
        F.round(F.exp(-jb / 2), 6).alias("p_normal"),
    )


#: Two-sided normal tail probabilities beyond 1 to 5 deviations.
TAILS = ((1, 0.31731), (2, 0.0455), (3, 0.0027), (4, 0.00006334), (5, 0.00000057))


def tails(bars: DataFrame) -> DataFrame:
    """How often returns lie beyond k deviations, against the normal share."""
    r = bars.where("log_return is not null")
    scale = r.groupBy("symbol").agg(F.avg("log_return").alias("mu"), F.stddev_samp("log_return").alias("sd"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("normal_share")) for k, p in TAILS))).alias("l")
    each = r.join(scale, "symbol").select("symbol", F.abs((F.col("log_return") - F.col("mu")) / F.col("sd")).alias("z"), levels)
    return each.groupBy("symbol", F.col("l.k").alias("k"), F.col("l.normal_share").alias("normal_share")).agg(F.count_if(F.col("z") > F.col("l.k")).alias("beyond"), F.round(F.avg((F.col("z") > F.col("l.k")).cast("double")), 6).alias("share"))


def candles(bars: DataFrame) -> DataFrame:
    q, bounds = F.col("q"), percentiles(bars, ["symbol"], "body_ratio", [0.1, 0.25, 0.5, 0.75, 0.9])
    sums = bars.groupBy("symbol").agg(F.count_if(F.col("is_bullish") == 1).alias("bullish"), F.count_if(F.col("is_bullish") == 0).alias("bearish"), F.round(F.avg("body_ratio"), 4).alias("mean_body_ratio"))
    return sums.join(bounds, "symbol", "left").select(*sums.columns, *(F.round(q[i], 4).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90"))))


def volume_links(bars: DataFrame) -> DataFrame:
    high = percentiles(bars, ["symbol"], "volume_ratio", [0.95]).select("symbol", F.round(F.col("q")[0], 4).alias("p95_ratio"))
    sums = bars.groupBy("symbol").agg(F.round(F.avg("volume_ratio"), 4).alias("mean_ratio"), F.round(F.corr("volume_ratio", F.abs("log_return")), 6).alias("corr_abs_return"))
    return sums.join(high, "symbol", "left")


def outliers(bars: DataFrame, times: float = 3.0, around: int = 15) -> DataFrame:
    """Bars whose range is so many ATRs, and how many bars lie around each."""
    far = bars.where(F.col("high") - F.col("low") > times * F.col("atr")).select("symbol", F.col("idx").alias("at"), F.col("ts").alias("outlier_ts"), F.round((F.col("high") - F.col("low")) / F.col("atr"), 4).alias("atr_multiple"))
    near = bars.select(F.col("symbol").alias("b_symbol"), "idx", "close")
    met = far.join(near, (F.col("symbol") == F.col("b_symbol")) & F.col("idx").between(F.col("at") - around, F.col("at") + around - 1))
    return met.groupBy("symbol", "outlier_ts", "atr_multiple").agg(F.count(F.lit(1)).alias("bars_around"), F.round(F.max("close") - F.min("close"), 2).alias("span_around"))


def trend_alignment(bars: DataFrame, recent: int = 252) -> DataFrame:
    """For each exponential mean over the last bars: share of closes above it, mean distance in ATRs."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    rows = bars.withColumn("place", place).where(F.col("place") <= recent)
    long = rows.select("symbol", "close", "atr", F.expr("stack(3, 'ema20', ema20, 'ema50', ema50, 'ema200', ema200) as (mean_name, mean_value)"))
    return long.groupBy("symbol", "mean_name").agg(F.count(F.lit(1)).alias("bars"), F.round(F.avg((F.col("close") > F.col("mean_value")).cast("double")), 6).alias("share_above"), F.round(F.avg((F.col("close") - F.col("mean_value")) / F.col("atr")), 4).alias("mean_distance_atr"))


def histogram(bars: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """How many values lie in each of so many equal bins (from 1), below them (0) and from high on (the last), where NaN is counted, too; nulls are left out."""
    x = F.col(column)
    inside = F.floor((x - low) / (high - low) * bins) + 1
    return bars.where(x.isNotNull()).groupBy("symbol", F.when(x < low, F.lit(0)).when(x >= high, F.lit(bins + 1)).otherwise(inside).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("bars"))


def plotting_positions(bars: DataFrame, column: str = "log_return") -> DataFrame:
    """Ranked values with their plotting positions, for quantile plots."""
    given = bars.where(F.col(column).isNotNull()).select("symbol", "ts", column)
    n = given.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return numbered(given, ["symbol"], [column, "ts"]).join(n, "symbol").select("symbol", "ts", "place", F.round((F.col("place") - 0.5) / F.col("n"), 6).alias("position"))


def describe(bars: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, std, least, exact quartiles, most."""
    long = bars.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
    q, bounds = F.col("q"), percentiles(long, ["column_name"], "v", [0.25, 0.5, 0.75])
    sums = long.groupBy("column_name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_samp("v"), 4).alias("std"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))
    return sums.join(bounds, "column_name", "left").select("column_name", "n", "mean", "std", "least", *(F.round(q[i], 4).alias(n) for i, n in enumerate(("q1", "median", "q3"))), "most")
