"""Trading metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.expr import ratio
from barline.functions.scans import running


def closed():
    """Trades that ended at their stop or target."""
    return F.col("outcome").isin("win", "loss", "trail_win")


def won():
    return F.col("outcome").isin("win", "trail_win")


def _stats(pnl: str) -> list:
    """Counts, rates and ratios; timeouts and open trades count in totals only. Null where there is nothing to divide by."""
    closed_r = F.when(closed(), F.col("r_multiple"))
    n = F.count_if(closed())
    gain, lost = F.sum(F.when(won(), F.col(pnl))), F.abs(F.sum(F.when(F.col("outcome") == "loss", F.col(pnl))))
    hold = F.greatest(F.avg(F.when(closed(), F.col("hold_candles"))), F.lit(1.0))
    sharpe = F.when(n >= 2, ratio(F.avg(closed_r), F.stddev_pop(closed_r)) * F.sqrt(252 / hold))
    return [
        F.count(F.lit(1)).alias("trades"),
        n.alias("closed"),
        F.count_if(won()).alias("wins"),
        F.count_if(F.col("outcome") == "loss").alias("losses"),
        F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.round(100 * ratio(F.count_if(won()).cast("double"), n.cast("double")), 2).alias("win_rate"),
        F.round(ratio(gain, lost), 3).alias("profit_factor"),
        F.round(F.avg(closed_r), 4).alias("avg_r"),
        F.round(F.sum(closed_r), 4).alias("total_r"),
        F.round(sharpe, 3).alias("sharpe_r"),
        F.round(F.sum(pnl), 2).alias("total_pnl"),
        *(F.round(F.avg(F.when(F.col("outcome").isin(*outcomes), F.col(pnl))), 2).alias(f"avg_{name}") for name, outcomes in (("timeout", ["timeout"]), ("win", ["win", "trail_win"]), ("loss", ["loss"]), ("trail_win", ["trail_win"]))),
    ]


def performance(curve: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Metrics of an equity table by keys."""
    return curve.groupBy(*keys).agg(*_stats("net_pnl"))


def structures(curve: DataFrame) -> DataFrame:
    """By symbol and structure, with subtotals over structures and over all (nulls)."""
    return curve.rollup("symbol", "structure").agg(*_stats("net_pnl"))


def drawdowns(curve: DataFrame, value: str = "equity_after_trade") -> DataFrame:
    """Largest fall from the running peak, and as a percentage of the overall peak."""
    run = running(curve, ["symbol"], F.floor(F.col("seq") / 4096), ["seq"], {"peak": ("max", F.col(value))})
    fall = run.withColumn("fall", F.col("peak") - F.col(value))
    return fall.groupBy("symbol").agg(F.round(F.max("fall"), 2).alias("max_drawdown"), F.round(100 * ratio(F.max("fall"), F.max(value)), 4).alias("max_drawdown_pct"), F.round(F.max_by(value, "seq"), 2).alias("final_equity"))


def r_drawdowns(trades: DataFrame) -> DataFrame:
    """The same over cumulative R of closed trades in order of entry."""
    day, order = F.col("entry_ts").cast("date"), ["entry_ts", "zone_id"]
    run = trades.where(closed()).withColumn("units", F.round(F.col("r_multiple") * 10000).cast("long"))  # R has four digits: whole sums are exact
    run = running(run, ["symbol"], day, order, {"run": ("sum", F.col("units"))}).withColumn("total", F.col("run") / 10000)
    run = running(run, ["symbol"], day, order, {"peak": ("max", F.col("total"))}).withColumn("fall", F.col("peak") - F.col("total"))
    return run.groupBy("symbol").agg(F.round(F.max("fall"), 4).alias("max_drawdown_r"), F.round(F.sum("r_multiple"), 4).alias("total_r"))


def pooled(performances: DataFrame) -> DataFrame:
    """Over symbols: trade-weighted win rate, medians."""
    return performances.agg(
        F.sum("closed").cast("long").alias("closed"),
        F.round(F.sum(F.col("closed") * F.col("win_rate")) / F.sum("closed"), 3).alias("win_rate"),
        F.round(F.expr("percentile(profit_factor, 0.5)"), 4).alias("median_profit_factor"),
        F.round(F.expr("percentile(total_pnl, 0.5)"), 3).alias("median_pnl"),
    )


def trade_stats(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    r = F.col("r_multiple")
    return trades.where(r.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((r > 0).cast("double")), 4).alias("win_share"),
        F.round(ratio(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))), 4).alias("profit_factor"),
        F.round(F.avg(r), 4).alias("avg_r"),
        F.round(F.sum(r), 4).alias("total_r"),
    )


def by_mode(trades: DataFrame) -> DataFrame:
    """Metrics in risk units of each mode of `trades.modes`, with the mean probability of winners and of losers."""
    r, p = F.when(closed(), F.col("r_multiple")), F.col("ml_prob")
    gain, lost = F.sum(F.when(F.col("outcome") == "win", F.col("r_multiple"))), F.abs(F.sum(F.when(F.col("outcome") == "loss", F.col("r_multiple"))))
    return trades.groupBy("mode").agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(closed()).alias("closed"),
        F.count_if(F.col("outcome") == "open").alias("open"),
        F.round(100 * ratio(F.count_if(won()).cast("double"), F.count_if(closed()).cast("double")), 2).alias("win_rate"),
        F.round(ratio(gain, lost), 3).alias("profit_factor"),
        F.round(F.avg(r), 4).alias("avg_r"),
        F.round(F.sum(r), 4).alias("total_r"),
        F.round(F.avg(F.when(won(), p)), 4).alias("mean_prob_won"),
        F.round(F.avg(F.when(F.col("outcome") == "loss", p)), 4).alias("mean_prob_lost"),
    )


def text_report(table: DataFrame, title: str) -> str:
    """A small table (a row for each symbol, mode or fold) as aligned text; the only place that formats on the driver."""
    rows = [table.columns, *([("-" if v is None else str(v)) for v in r] for r in table.collect())]
    widths = [max(len(r[k]) for r in rows) for k in range(len(table.columns))]
    return "\n".join([title, *("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in rows)])
