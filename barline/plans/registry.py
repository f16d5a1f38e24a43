"""The registered queries: operators applied to bars made from `events`, each over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.config import TradeConfig, ZoneConfig
from barline.operators import confluence, indicators, labels, metrics, models, patterns, quality, trades, windows, zones
from barline.plans.sql import SQL
from barline.sources import bars as sources
from barline.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The registered queries fit fewer trees than the library's own sizes (README has what that costs); everything else is as there.
FEW_WINDOWS = models.WINDOWS._replace(trees=20, step=0.1)
FEW_OUTCOMES = models.OUTCOMES._replace(trees=20, depth=4, step=0.1)
FEW_STRUCTURES = models.STRUCTURES._replace(trees=60, depth=8)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.bars_from_events(spark, sf_dir)


def _ind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with indicators; most queries read them several times."""
    return written(indicators.with_indicators(_bars(spark, sf_dir)), "indicators")


def _zones(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = _ind(spark, sf_dir)
    return written(zones.scored_zones(b), "zones"), b


def _lived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    z, b = _zones(spark, sf_dir)
    return written(zones.lifecycle(z, b), "lived"), b


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged zones with scores, lifecycle and confluence, in order of formation."""
    b = _ind(spark, sf_dir)
    found = written(zones.lifecycle(written(zones.merged(written(zones.scored_zones(b), "zones")), "merged"), b), "lived")
    found = zones.finished(confluence.confluence(found, confluence.higher(b, hours=6)))
    return found.orderBy("symbol", "formation_ts", "zone_id")


@query
def bars_ohlcv(spark, sf_dir):
    return _bars(spark, sf_dir)


@query
def row_gate(spark, sf_dir):
    return indicators.row_gate(_bars(spark, sf_dir))


@query
def base_windows(spark, sf_dir):
    b = zones.bases(_ind(spark, sf_dir)).where("n is not null")
    return _rounded(b.select("symbol", F.col("idx").cast("long").alias("idx"), "n", "top", "bottom", "avg_atr", "wick"), top=2, bottom=2, avg_atr=3, wick=5)


# named apart from the module of the same name
def _indicators(spark, sf_dir):
    b = _ind(spark, sf_dir).select("symbol", "ts", F.col("idx").cast("long").alias("idx"), "true_range", "atr", "ema20", "ema50", "ema200", "sma20", "sma50", "sma200", "log_return", "rolling_volatility", "volume_ratio", "body_ratio", "is_bullish", "is_outlier")
    return _rounded(b, true_range=2, atr=3, ema20=3, ema50=3, ema200=3, sma20=6, sma50=6, sma200=6, log_return=9, rolling_volatility=9, volume_ratio=6, body_ratio=6)


QUERIES["indicators"] = _indicators

ZONE_COLUMNS = (
    "symbol zone_id type structure top bottom midpoint proximal distal width_atr formation_ts formation_idx base_length avg_atr leg_out_clear_atr leg_out_disp_atr leg_out_candles "
    "leg_out_vol_exp leg_in_disp_atr arrival_cleanliness trend_score strength quality_score"
).split()


@query
def zones_scored(spark, sf_dir):
    return _zones(spark, sf_dir)[0].select(ZONE_COLUMNS)


@query
def zones_merged(spark, sf_dir):
    return zones.merged(_zones(spark, sf_dir)[0]).select("symbol", "zone_id", "type", "formation_ts", "quality_score", "merged_count")


@query
def zones_detected(spark, sf_dir):
    return flagship(spark, sf_dir)


@query
def zone_lifecycle(spark, sf_dir):
    return _lived(spark, sf_dir)[0].select("symbol", "zone_id", "type", "status", "test_count", "last_test_ts", "invalidation_ts", F.col("freshness_score").cast("double").alias("freshness_score"))


@query
def zone_summary(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    return zones.summary(zones.lifecycle(written(zones.merged(z), "merged"), b)).withColumn("mean_quality", F.round("mean_quality", 3))


@query
def zones_reversal(spark, sf_dir):
    """Zones whose arrival turns at the base, from beyond it."""
    only = ZoneConfig(leg_in_enabled=True, arrival_mode="reversal", arrival_origin=True, leg_in_min_move=0.5)
    return zones.raw_zones(_ind(spark, sf_dir), only).select("symbol", "formation_ts", "type", "structure", "leg_in_disp_atr")


@query
def zones_of_quality(spark, sf_dir):
    """Zones of a quality of 70 at least; those left out have no number."""
    return zones.scored_zones(_ind(spark, sf_dir), ZoneConfig(min_quality=0.7)).select("symbol", "zone_id", "type", "structure", "formation_ts", "quality_score")


@query
def zone_ranks(spark, sf_dir):
    """Ranks by a probability that not every zone has; here a strength of a half or more stands for it."""
    z = _zones(spark, sf_dir)[0].withColumn("ml_prob", F.when(F.col("strength") >= 0.5, F.col("strength")))
    return models.ranks(z).select("symbol", "zone_id", "ml_prob", "ml_rank")


@query
def zone_reactions(spark, sf_dir):
    return patterns.zone_reactions(*_zones(spark, sf_dir))


@query
def htf_bars(spark, sf_dir):
    return sources.resample(_bars(spark, sf_dir), hours=6).drop("last_ts")


@query
def weekly_bars(spark, sf_dir):
    return sources.resample(_bars(spark, sf_dir)).drop("last_ts")


@query
def htf_confluence(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    found = confluence.confluence(z, confluence.higher(b, hours=6))
    return found.select("symbol", "zone_id", "htf_trend_align", "htf_in_zone", "htf_dist_atr", "htf_zone_strength", "htf_zone_fresh", "htf_confirmed", "htf_confluence")


@query
def formation_stamp(spark, sf_dir):
    z, b = _lived(spark, sf_dir)
    return labels.formations(b.select("symbol", "ts"), z)


@query
def active_context(spark, sf_dir):
    z, b = _lived(spark, sf_dir)
    got = labels.context(b.select("symbol", "ts", "idx", "close"), z)
    return got.select("symbol", "ts", *(f"{x}_{t}_{y}" for t in ("demand", "supply") for x, y in (("active", "count"), ("price_in", "zone"), ("nearest", "dist_pct"), ("nearest", "strength"), ("nearest", "structure"))), "zone_confluence")


@query
def labelled_formations(spark, sf_dir):
    z, b = _lived(spark, sf_dir)
    return labels.formed(labels.label(b, z))


def _trades(spark, sf_dir, t: TradeConfig = TradeConfig()) -> DataFrame:
    z, b = _zones(spark, sf_dir)
    got = trades.simulate(z, b, t)
    columns = ["symbol", "zone_id", "type", "structure", "formation_ts", "entry_ts", "exit_ts", "entry_price", "stop_price", "target_price", "exit_price", "outcome", "hold_candles", "r_multiple"]
    return _rounded(got.select(columns), entry_price=2, stop_price=2, target_price=2, exit_price=2)


@query
def trades_fixed(spark, sf_dir):
    return _trades(spark, sf_dir)


@query
def trades_target_first(spark, sf_dir):
    """A bar that reaches both stop and target counts as a win."""
    return _trades(spark, sf_dir, TradeConfig(target_first=True))


@query
def trades_confirm(spark, sf_dir):
    return _trades(spark, sf_dir, TradeConfig(confirm=True))


@query
def trades_atr_stop(spark, sf_dir):
    return _trades(spark, sf_dir, TradeConfig(stop_atr=1.5))


@query
def trades_trailing(spark, sf_dir):
    return _trades(spark, sf_dir, TradeConfig(trail=True, max_hold=20))


@query
def trades_filtered(spark, sf_dir):
    """Trades of two structures within bounds of strength."""
    z, b = _zones(spark, sf_dir)
    t = TradeConfig(min_strength=0.6, max_strength=0.85, structures=("DBR", "RBD"))
    got = trades.simulate(zones.finished(z.withColumn("freshness_score", F.lit(1.0))), b, t)
    columns = ["symbol", "zone_id", "type", "structure", "formation_ts", "entry_ts", "exit_ts", "entry_price", "stop_price", "target_price", "exit_price", "outcome", "hold_candles", "r_multiple"]
    return _rounded(got.select(columns), entry_price=2, stop_price=2, target_price=2, exit_price=2)


@query
def trades_modes(spark, sf_dir):
    """All zones against those whose probability passes; the strength at formation stands for a probability."""
    z, b = _zones(spark, sf_dir)
    return metrics.by_mode(trades.modes(z.withColumn("ml_prob", F.col("strength")), b, 0.6))


@query
def trade_baselines(spark, sf_dir):
    made = patterns.baselines(*_zones(spark, sf_dir))
    return made.groupBy("baseline", "outcome").agg(F.count(F.lit(1)).alias("trades"), F.round(F.avg("r_multiple"), 4).alias("avg_r"))


@query
def trades_r(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    return _rounded(trades.simulate_r(z, b), entry_price=2, stop_price=2, target_price=2, exit_price=2)


def _equity(spark, sf_dir) -> DataFrame:
    z, b = _zones(spark, sf_dir)
    return trades.equity(trades.simulate(z, b))


@query
def equity_curve(spark, sf_dir):
    return _rounded(_equity(spark, sf_dir).select("symbol", F.col("seq").cast("long").alias("seq"), "zone_id", "outcome", "capital_at_entry", "net_pnl", "equity_after_trade"), capital_at_entry=2)


@query
def performance(spark, sf_dir):
    return metrics.performance(_equity(spark, sf_dir))


@query
def structure_rollup(spark, sf_dir):
    return metrics.structures(_equity(spark, sf_dir))


@query
def drawdown(spark, sf_dir):
    return metrics.drawdowns(_equity(spark, sf_dir))


@query
def drawdown_r(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    return metrics.r_drawdowns(trades.simulate(z, b))


@query
def pooled_summary(spark, sf_dir):
    return metrics.pooled(metrics.performance(_equity(spark, sf_dir)))


@query
def trade_statistics(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    return metrics.trade_stats(trades.simulate(z, b))


@query
def quality_profile(spark, sf_dir):
    return quality.profile(_bars(spark, sf_dir))


@query
def quality_describe(spark, sf_dir):
    return quality.describe(_ind(spark, sf_dir), ["close", "volume", "atr", "log_return"])


@query
def filled_bars(spark, sf_dir):
    """A row for every hour, with the close of up to three hours before where there is none."""
    grid = indicators.filled(sources.regular(_bars(spark, sf_dir)), ["close"])
    return grid.select("symbol", "ts", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query
def quality_nulls(spark, sf_dir):
    return quality.nulls(_ind(spark, sf_dir), ["close", "atr", "sma200", "rolling_volatility"])


@query
def quality_integrity(spark, sf_dir):
    return quality.integrity(_bars(spark, sf_dir))


@query
def quality_gaps(spark, sf_dir):
    return quality.gaps(_bars(spark, sf_dir))


@query
def quality_duplicates(spark, sf_dir):
    return quality.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))


@query
def atr_stats(spark, sf_dir):
    return quality.atr_stats(_ind(spark, sf_dir))


@query
def volatility_regimes(spark, sf_dir):
    return quality.regimes(_ind(spark, sf_dir))


@query
def atr_by_day(spark, sf_dir):
    return quality.by_period(_ind(spark, sf_dir))


@query
def return_moments(spark, sf_dir):
    return quality.moments(_ind(spark, sf_dir)).drop("jarque_bera", "p_normal")


@query
def return_normality(spark, sf_dir):
    return quality.moments(_ind(spark, sf_dir)).select("symbol", "returns", "jarque_bera", "p_normal")


@query
def tail_frequency(spark, sf_dir):
    return quality.tails(_ind(spark, sf_dir))


@query
def candle_shape(spark, sf_dir):
    return quality.candles(_ind(spark, sf_dir))


@query
def volume_links(spark, sf_dir):
    return quality.volume_links(_ind(spark, sf_dir))


@query
def range_outliers(spark, sf_dir):
    return quality.outliers(_ind(spark, sf_dir), 2.0)


@query
def ma_alignment(spark, sf_dir):
    return quality.trend_alignment(_ind(spark, sf_dir))


@query
def return_histogram(spark, sf_dir):
    return quality.histogram(_ind(spark, sf_dir), "log_return", -0.005, 0.005)


@query
def plotting_positions(spark, sf_dir):
    return quality.plotting_positions(_ind(spark, sf_dir))


@query
def window_features(spark, sf_dir):
    """All 145 features of every window, under names that SQL takes too."""
    f = windows.features(_ind(spark, sf_dir))
    return f.select("symbol", "ts", *(F.round(f"`{c}`", 4).alias(c.replace("c-", "cm").replace("c+", "cp")) for c in windows.names()))


@query
def window_labels(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    return windows.labelled(windows.features(b), z).groupBy("symbol", "zone_type", "label").agg(F.count(F.lit(1)).alias("windows"))


@query
def base_end_examples(spark, sf_dir):
    z, b = _zones(spark, sf_dir)
    columns = "symbol example_type is_zone zone_id base_end_ts leg_in_disp_atr leg_in_direction leg_in_velocity base_length base_wick_frac base_range_atr base_volume_ratio atr_level close_vs_ema200 close_vs_ema50 is_bullish_last leg_in_bullish_ratio"
    return windows.examples(z, b).select(columns.split())


@query
def example_nulls(spark, sf_dir):
    """The missing-value report of the examples."""
    found = windows.examples(*_zones(spark, sf_dir))
    return quality.nulls(found, ["leg_in_disp_atr", "base_volume_ratio", "close_vs_ema200", "rolling_volatility", "quality_score_ao"])


@query
def rebuilt_zones(spark, sf_dir):
    """Windows on whose last bar a zone forms, rebuilt from their bars alone, thinned out, with their life; the zone's quality stands for a probability."""
    z, b = _zones(spark, sf_dir)
    probs = z.groupBy("symbol", F.col("formation_idx").alias("idx")).agg((F.max("quality_score") / 100).alias("ml_prob"))
    found = windows.ml_lifecycle(written(windows.deduplicated(written(windows.reconstructed(b, probs), "rebuilt")), "thin"), b)
    return _rounded(found.drop("idx"), ml_prob=4)


def _window_rows(z, b) -> tuple[DataFrame, list[str]]:
    """Labelled windows with all features under plain names."""
    named = {c: c.replace("c-", "cm").replace("c+", "cp") for c in windows.names()}
    rows = windows.labelled(windows.features(b), z)
    return rows.select("symbol", "ts", "idx", "label", *(F.col(f"`{c}`").alias(n) for c, n in named.items())), list(named.values())


@query
def model_zones(spark, sf_dir):
    """Window probabilities of walk-forward boosted trees over all features, rebuilt to zones, without overlaps, with their lifecycle. Windows before the
    first test fold, which no model can score unseen, are scored by the first one; `seen` marks their zones.
    """
    z, b = _zones(spark, sf_dir)
    rows, given = _window_rows(z, b)
    scored = models.walk_forward(rows, given, ["ts", "symbol"], kind="gbt", splits=4, size=FEW_WINDOWS, first_too=True)
    scored = written(scored.select("symbol", "idx", F.col("p").alias("ml_prob"), "seen"), "scored")
    found = written(windows.reconstructed(b, scored.drop("seen")), "rebuilt")
    return windows.ml_lifecycle(written(windows.deduplicated(found).join(scored.drop("ml_prob"), ["symbol", "idx"]), "thin"), b)


def _structures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    z, b = _lived(spark, sf_dir)
    rows = written(models.structure_rows(labels.label(b, z)), "classes")
    return z, models.walk_forward(rows, models.STRUCTURE_FEATURES, ["ts", "symbol"], kind="forest", splits=5, size=FEW_STRUCTURES)


@query
def structure_report(spark, sf_dir):
    """Five classes of bars by a walk-forward forest: precision, recall and F1 of each."""
    report = models.class_report(_structures(spark, sf_dir)[1])
    names = F.create_map(*(F.lit(x) for k, n in enumerate(models.CLASSES) for x in (str(k), n)))
    return report.withColumn("class", F.coalesce(names[F.col("class")], F.col("class")))


@query
def zone_probabilities(spark, sf_dir):
    """Zones by the probability that one forms on their bar, from the same forest."""
    z, scored = _structures(spark, sf_dir)
    return models.score_zones(z, scored).select("symbol", "zone_id", "formation_ts", F.round("ml_prob", 4).alias("ml_prob"), "ml_rank")


def _outcomes(spark, sf_dir) -> DataFrame:
    z, b = _zones(spark, sf_dir)
    return written(models.outcome_rows(trades.simulate(z, b).where("outcome <> 'timeout'"), z), "outcomes")


OUTCOME_ORDER = ["entry_ts", "symbol", "zone_id"]


@query
def outcome_report(spark, sf_dir):
    return models.report(models.walk_forward(_outcomes(spark, sf_dir), models.OUTCOME_FEATURES, OUTCOME_ORDER, kind="gbt", splits=5, size=FEW_OUTCOMES))


@query
def outcome_baseline(spark, sf_dir):
    """The same by logistic regression."""
    return models.report(models.walk_forward(_outcomes(spark, sf_dir), models.OUTCOME_FEATURES, OUTCOME_ORDER, splits=5))


@query
def outcome_thresholds(spark, sf_dir):
    return models.tuned_threshold(models.walk_forward(_outcomes(spark, sf_dir), models.OUTCOME_FEATURES, OUTCOME_ORDER, splits=5, train_too=True))


@query
def outcome_shuffled(spark, sf_dir):
    """The control: labels permuted over all trades, fitted and tested again."""
    rows = written(models.shuffled(_outcomes(spark, sf_dir), OUTCOME_ORDER), "shuffled")
    return models.report(models.walk_forward(rows, models.OUTCOME_FEATURES, OUTCOME_ORDER, splits=5))


@query
def outcome_importances(spark, sf_dir):
    """The fifteen features that boosted trees over all trades weigh most."""
    fitted = models.pipeline(models.OUTCOME_FEATURES, size=FEW_OUTCOMES).fit(models.weighted(_outcomes(spark, sf_dir)))
    return models.importances(fitted, models.OUTCOME_FEATURES, spark)


@query
def swing_points(spark, sf_dir):
    return patterns.swings(_bars(spark, sf_dir))


@query
def price_clusters(spark, sf_dir):
    return patterns.price_clusters(_bars(spark, sf_dir))


@query
def price_cluster_zones(spark, sf_dir):
    return patterns.cluster_zones(_bars(spark, sf_dir))


@query
def volume_profile(spark, sf_dir):
    return patterns.volume_profile(_bars(spark, sf_dir))


@query
def candle_patterns(spark, sf_dir):
    return patterns.candle_patterns(_bars(spark, sf_dir))


@query
def oscillators(spark, sf_dir):
    return patterns.oscillators(_ind(spark, sf_dir))


@query
def movement_labels(spark, sf_dir):
    return patterns.movement_labels(_ind(spark, sf_dir))


@query
def merged_ranges(spark, sf_dir):
    return patterns.merged_ranges(_zones(spark, sf_dir)[0])


@query
def buy_and_hold(spark, sf_dir):
    return patterns.buy_and_hold(_bars(spark, sf_dir))


ORACLES = dict(SQL)
