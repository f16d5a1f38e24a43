"""Walk-forward models, their reports and thresholds on small seeded tables, and what reads and writes them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barline.config import TradeConfig
from barline.operators import metrics, models, patterns, quality, trades, zones
from barline.sources import bars as sources
from test_zones import made  # noqa: F401  bars of three symbols


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for k in range(360):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        label = int(x + 0.3 * rng.gauss(0, 1) > 0)
        out.append((k, x, y, label, (1.0 if label else -1.0) * rng.random()))
    return spark.createDataFrame(out, "id long, x double, y double, label int, r_multiple double").persist()


def test_walk_forward_learns_and_its_control_does_not(rows):
    fair = models.report(models.walk_forward(rows, ["x", "y"], ["id"], splits=3)).collect()
    assert [r.fold for r in sorted(fair, key=lambda r: r.fold)] == [1, 2, 3] and all(r.rows == 90 and r.auc > 0.9 for r in fair)
    mixed = models.shuffled(rows, ["id"])
    assert sorted(r.label for r in mixed.collect()) == sorted(r.label for r in rows.collect())
    assert mixed.where((F.col("label") == 1) != (F.col("r_multiple") > 0)).count() == 0
    control = models.report(models.walk_forward(mixed, ["x", "y"], ["id"], splits=3)).collect()
    assert all(0.3 < r.auc < 0.7 for r in control)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_trees(rows, kind):
    got = models.report(models.walk_forward(rows, ["x", "y"], ["id"], kind=kind, splits=1, size=models.Trees(20, 4, 5))).first()
    assert got.rows == 180 and got.auc > 0.9


def test_threshold_comes_from_training_rows_alone(spark):
    train = [(1, "train", k / 10, r) for k, r in enumerate([-1.0, -1.0, -1.0, 0.5, -1.0, 1.0, 1.0, -0.5, 1.0, 1.0])]
    test = [(1, "test", p, r) for p, r in ((0.1, 9.0), (0.55, 1.0), (0.45, 7.0), (0.9, -1.0))]
    got = models.tuned_threshold(spark.createDataFrame(train + test, "fold int, part string, p double, r_multiple double")).first()
    # by hand: of the quantiles 0, 0.027, ..., 0.81 those in (0.4, 0.5] keep five rows with a sum of 3.5, more than any other; the lowest is the fifteenth, at 0.9 * 15 / 30 of 0.9
    assert got.threshold == pytest.approx(0.405) and (got.trades, got.kept, got.kept_r, got.all_r) == (4, 3, 7.0, 16.0)


def test_class_report(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 1)] * 2 + [(2, 0)] * 2
    got = {r["class"]: r for r in models.class_report(spark.createDataFrame(pairs, "label int, predicted int")).collect()}
    assert (got["0"].support, got["0"].precision, got["0"].recall) == (6, 0.7143, 0.8333) and (got["1"].precision, got["1"].recall) == (0.6667, 1.0) and got["2"].f1 == 0.0
    assert got["macro"].recall == pytest.approx((0.8333 + 1 + 0) / 3, abs=1e-4) and got["weighted"].recall == pytest.approx(0.7, abs=1e-3)


def test_importances_and_saved_models(spark, rows, tmp_path):
    fitted = models.pipeline(["x", "y"], size=models.Trees(20, 4, 5)).fit(models.weighted(rows))
    found = models.importances(fitted, ["x", "y"], spark, 1).collect()
    assert [(r.feature, r.place) for r in found] == [("x", 1)]
    models.save(fitted, str(tmp_path / "model"))
    again = models.load(str(tmp_path / "model"))
    key = lambda m: [r.prediction for r in m.transform(rows).orderBy("id").collect()]
    assert key(again) == key(fitted)


def test_zone_scores_and_ranks(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    z = spark.createDataFrame([("A", "Z1", day(1)), ("A", "Z2", day(2)), ("A", "Z3", day(3)), ("A", "Z4", day(2))], "symbol string, zone_id string, formation_ts timestamp_ntz")
    scored = spark.createDataFrame([("A", day(1), [0.75, 0.25]), ("A", day(2), [0.25, 0.75])], "symbol string, ts timestamp_ntz, probabilities array<double>")
    got = {r.zone_id: (r.ml_prob, r.ml_rank) for r in models.score_zones(z, scored).collect()}
    assert got == {"Z1": (0.25, 3), "Z2": (0.75, 1), "Z4": (0.75, 2), "Z3": (None, None)}


def test_structure_rows(spark, made):  # noqa: F811
    from barline.operators import labels

    _, bars = made
    lived = zones.lifecycle(zones.scored_zones(bars), bars)
    got = models.structure_rows(labels.label(bars, lived))
    assert got.columns == ["symbol", "ts", "label", *models.STRUCTURE_FEATURES]
    assert got.where("label > 0").count() > 0 and got.where("nearest_demand_dist_pct is null").count() == 0


def test_modes_baselines_and_strict(made):  # noqa: F811
    _, bars = made
    z = zones.scored_zones(bars).persist()
    without = trades.modes(z.withColumn("ml_prob", F.lit(None).cast("double")), bars, 0.5)
    assert {r.mode for r in without.select("mode").distinct().collect()} == {"baseline"}
    some = trades.modes(z.withColumn("ml_prob", F.when(F.col("strength") > 0.5, F.col("strength"))), bars, 0.6).collect()
    passed = {(r.symbol, r.zone_id) for r in some if r.mode == "filtered"}
    assert passed == {(r.symbol, r.zone_id) for r in some if r.mode == "baseline" and (r.ml_prob is None or r.ml_prob >= 0.6)}
    kinds = patterns.baselines(z, bars).groupBy("baseline").count().collect()
    assert {r.baseline for r in kinds} == {"always_reversal", "random_entry", "indicator"}
    late = {(r.symbol, r.zone_id): r.entry_ts for r in trades.entries(z, bars, strict=True).collect()}
    ends = {(r.symbol, r.zone_id): r.ts for r in z.join(bars.select("symbol", F.col("idx").alias("leg_end_idx"), "ts"), ["symbol", "leg_end_idx"]).collect()}
    assert late and all(ts > ends[k] for k, ts in late.items())
    optimist = trades.simulate(z, bars, TradeConfig(target_first=True)).where("outcome = 'win'").count()
    assert optimist >= trades.simulate(z, bars).where("outcome = 'win'").count()


def test_reports_and_descriptions(spark, made):  # noqa: F811
    table = spark.createDataFrame([("A", 1.5, None), ("BB", 12.25, 3)], "symbol string, total_r double, n int")
    assert metrics.text_report(table, "Totals").splitlines() == ["Totals", "symbol  total_r  n", "     A      1.5  -", "    BB    12.25  3"]
    got = {r.column_name: r for r in quality.describe(made[1], ["volume", "atr"]).collect()}
    assert got["volume"].n == made[1].count() and got["volume"].least <= got["volume"].q1 <= got["volume"].median <= got["volume"].most


def test_zone_files(spark, tmp_path):
    head = "symbol,zone_id,type,structure,top,bottom,strength_pit,ml_prob,formation_ts,base_start_ts,base_end_ts,last_test_ts,invalidation_ts"
    (tmp_path / "rule.csv").write_text(f"{head}\nA,Z1,demand,DBR,2,1,0.5,,2024-01-05 00:00:00+05:30,2024-01-02,2024-01-04,,\n")
    (tmp_path / "ml.csv").write_text(f"{head}\nA,ML_0,supply,RBD,2,1,,0.7,2024-01-05,,,,2024-02-01\nA,ML_1,supply,RBD,3,2,,,2024-01-06,,,,\n")
    rule, ml = sources.read_zones(spark, str(tmp_path / "rule.csv")).first(), sources.read_zones(spark, str(tmp_path / "rule.csv"), str(tmp_path / "ml.csv")).orderBy("zone_id").collect()
    assert (rule.zone_id, rule.strength_pit, str(rule.formation_ts), str(rule.base_start_ts), rule.last_test_ts) == ("Z1", 0.5, "2024-01-05 00:00:00", "2024-01-02 00:00:00", None)
    assert [(r.zone_id, r.strength_pit) for r in ml] == [("ML_0", 0.7), ("ML_1", None)] and str(ml[0].invalidation_ts) == "2024-02-01 00:00:00"
    sources.write(spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, x double"), str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_regular_bars_and_bounded_fill(spark):
    from barline.operators import indicators

    at = lambda k: dt.datetime(2024, 1, 1, k)
    rows = [("A", at(k), float(k)) for k in (0, 1, 7)] + [("B", at(3), 5.0)]
    got = {(r.symbol, r.ts.hour): r.close for r in indicators.filled(sources.regular(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double")), ["close"]).collect()}
    assert got == {("A", 0): 0.0, ("A", 1): 1.0, ("A", 2): 1.0, ("A", 3): 1.0, ("A", 4): 1.0, ("A", 5): None, ("A", 6): None, ("A", 7): 7.0, ("B", 3): 5.0}


def test_missing_values_are_flagged_and_first_rows_scored(spark):
    """What is missing tells the label: only an indicator can say so after the median fills the gap. Rows before the first fold are marked as seen."""
    rng = random.Random(5)
    rows = [(k, None if k % 3 == 0 else rng.gauss(0, 1), rng.gauss(0, 1), int(k % 3 == 0)) for k in range(240)]
    given = spark.createDataFrame(rows, "id long, x double, y double, label int").withColumn("r_multiple", F.lit(1.0))
    scored = models.walk_forward(given, ["x", "y"], ["id"], kind="gbt", splits=2, size=models.Trees(5, 3, 2, step=0.3), first_too=True).persist()
    assert scored.count() == 240 and scored.where("seen").count() == scored.where("id < 80").count() == 80
    assert all(r.auc == 1.0 for r in models.report(scored.where("not seen")).collect())


def test_auc_with_ties_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randint(1, 2), int(rng.random() < 0.4), rng.randint(0, 12) / 12) for _ in range(300)]
    got = {r.fold: r.auc for r in models.report(spark.createDataFrame(rows, "fold int, label int, p double")).collect()}
    for fold in (1, 2):
        pos, neg = ([p for f, y, p in rows if f == fold and y == k] for k in (1, 0))
        assert got[fold] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg), abs=1e-4)


def test_library_sizes():
    assert models.WINDOWS.trees == 500 and models.OUTCOMES.trees == 200 and models.STRUCTURES.trees == 300
    stages = models.pipeline(["x"], size=models.WINDOWS).getStages()
    assert stages[-1].getMaxIter() == 500 and stages[-1].getCheckpointInterval() == 10


def test_percentiles_and_places(spark):
    from barline.functions import scans

    rng = random.Random(7)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, rng.random() * 5])) for _ in range(500)] + [("d", 4.0), ("e", None)]
    given = spark.createDataFrame(rows, "s string, v double").persist()
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    want = {r.s: r.q for r in given.groupBy("s").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() if r.q}
    assert {r.s: r.q for r in scans.percentiles(given, ["s"], "v", shares).collect()} == want
    all_ = given.agg(F.percentile("v", F.lit(0.3))).first()[0]
    assert scans.percentiles(given, [], "v", [0.3]).first().q == [all_]
    found = scans.numbered(given.where("v is not null"), ["s"], ["v"]).collect()
    for s in "abcd":
        mine = sorted((r.place, r.v) for r in found if r.s == s)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_recoded_and_keys(spark):
    from barline.functions import expr

    got = spark.createDataFrame([("True", "^NSEI"), ("False", "A.NS"), ("x", "B"), (None, "^X.Y")], "b string, s string").select(expr.recoded(F.col("b")), expr.recoded(F.col("b") == "True"), expr.symbol_key(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(1, 1, "IDX_NSEI"), (0, 0, "A_NS"), (0, 0, "B"), (0, 0, "IDX_X.Y")]


def test_datasets_and_names(spark, made, tmp_path):  # noqa: F811
    from barline.operators import labels, windows

    _, bars = made
    lived = zones.lifecycle(zones.scored_zones(bars), bars)
    labelled = labels.label(bars, lived).persist()
    labelled.withColumnRenamed("ts", "Date").coalesce(1).write.option("header", True).csv(str(tmp_path / "labelled"))
    again = sources.read_labelled(spark, str(tmp_path / "labelled"), ["atr", "ema20"])
    key = lambda df: sorted((r.symbol, r.ts, r.zone_formed_count, r.active_demand_count, r.nearest_demand_dist_pct, r.zone_formed_structure, r.atr) for r in df.where("atr is not null").collect())
    assert key(again) == key(labelled)
    made_ = windows.labelled(windows.features(bars), lived)
    made_.drop("idx", "atr").withColumnRenamed("ts", "Date").coalesce(1).write.option("header", True).csv(str(tmp_path / "windows"))
    got = sources.read_windows(spark, str(tmp_path / "windows"), windows.names())
    assert got.count() == made_.count() and got.agg(F.sum("label")).first()[0] == made_.agg(F.sum("label")).first()[0]
    assert got.agg(F.round(F.sum("`c-3_body_atr`"), 6)).first()[0] == made_.agg(F.round(F.sum("`c-3_body_atr`"), 6)).first()[0]
    sources.write_names(spark, windows.names(), str(tmp_path / "names"))
    assert sources.read_names(spark, str(tmp_path / "names")) == windows.names()
