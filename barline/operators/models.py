"""Walk-forward models on Spark ML: zone windows and trade outcomes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.expr import ratio, recoded
from barline.functions.scans import numbered, percentiles, ranged, running
from barline.sources.shared import shared_dir, written


class Trees(NamedTuple):
    """An ensemble: trees, their depth, the fewest rows of a leaf, and for boosting its step; rows and columns: what each tree or split sees of them."""

    trees: int
    depth: int
    least: int
    step: float = 0.05
    rows: float = 0.8
    columns: str = "sqrt"


#: The sizes of the models of windows, of trade outcomes and of bar classes (depth 30 is the deepest that Spark ML grows).
WINDOWS = Trees(500, 4, 10, columns="0.6")
OUTCOMES = Trees(200, 3, 8, columns="0.7")
STRUCTURES = Trees(300, 30, 5, rows=1.0)

#: What is known when a zone forms; freshness is not, as it comes from later tests.
POINT_IN_TIME = (
    "width_atr base_length base_wick_frac base_volume_ratio departure_body_atr departure_close_ratio leg_out_clear_atr leg_out_disp_atr leg_out_candles "
    "leg_out_velocity leg_out_vol_exp departure_volume_ratio leg_in_disp_atr leg_in_candles leg_in_velocity arrival_cleanliness disp_base_ratio trend_score strength quality_score"
).split()


def folds(rows: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """Adds fold: the last `splits` blocks of n // (splits + 1) rows are 1, 2, ..., what comes before is 0. A block is tested by a model of
    all rows of earlier folds. Ranks come from ranges, not from one sorted task.
    """
    from barline.plans.ranks import ranked

    numbered, n = ranked(rows, order)
    size = F.greatest(F.floor(F.lit(n) / (splits + 1)), F.lit(1))
    return numbered.withColumn("fold", F.greatest(F.floor((F.col("rank") - 1 - (n - splits * size)) / size) + 1, F.lit(0)).cast("int")).drop("rank")


def pipeline(columns: list[str], kind: str = "gbt", missing: float | None = None, size: Trees | None = None, flagged: list[str] = ()) -> Pipeline:
    """Median imputation inside the training rows (or a constant for missing values), assembly, and a weighted classifier: gbt, forest
    (any number of classes) or logistic (standardised). size: of the trees, OUTCOMES or STRUCTURES unless given.

    flagged: columns that may be missing. Each gets an indicator beside it, so that a tree can send missing values its own way.
    """
    filled, flags = [f"{c}__f" for c in columns], [f"{c}__m" for c in flagged]
    fill = [Imputer(strategy="median", inputCols=columns, outputCols=filled)] if missing is None else []
    if flags:
        marks = ", ".join(f"CAST(`{c}` IS NULL OR isnan(`{c}`) AS DOUBLE) AS `{m}`" for c, m in zip(flagged, flags, strict=True))
        fill.insert(0, SQLTransformer(statement=f"SELECT *, {marks} FROM __THIS__"))
    stages = [*fill, VectorAssembler(inputCols=[*(columns if missing is not None else filled), *flags], outputCol="raw", handleInvalid="keep")]
    size = size or (STRUCTURES if kind == "forest" else OUTCOMES)
    common = {"labelCol": "label", "weightCol": "weight", "featuresCol": "raw"}
    if kind == "logistic":
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled", withMean=True))
        stages.append(LogisticRegression(**common | {"featuresCol": "scaled"}, maxIter=50, regParam=0.01))
    elif kind == "forest":
        stages.append(RandomForestClassifier(**common, numTrees=size.trees, maxDepth=size.depth, featureSubsetStrategy=size.columns, minInstancesPerNode=size.least, subsamplingRate=size.rows, seed=42))
    else:
        stages.append(GBTClassifier(**common, maxIter=size.trees, maxDepth=size.depth, stepSize=size.step, subsamplingRate=size.rows, featureSubsetStrategy=size.columns, minInstancesPerNode=size.least, checkpointInterval=10, seed=42))
    return Pipeline(stages=stages)


def save(model: PipelineModel, path: str) -> None:
    """A fitted model in Spark ML's own format, in a folder that all executors share."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def weighted(rows: DataFrame) -> DataFrame:
    """Adds weight: rows of all other classes over those of a row's class, at 1 for the most frequent one (label 0 against 1: 1 and negatives over positives)."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))  # a row for each class
    most = counts.agg(F.max("_n")).scalar()
    return rows.join(F.broadcast(counts.withColumn("weight", most / F.col("_n")).drop("_n")), "label")


def walk_forward(rows: DataFrame, columns: list[str], order: list[str], kind: str = "logistic", splits: int = 5, least: int = 5, train_too: bool = False, missing: float | None = None, size: Trees | None = None, first_too: bool = False) -> DataFrame:
    """Out-of-sample rows with p (of class 1), all class probabilities and fold; with train_too those of each fold's training rows as well, told apart by part
    (`train`, `test`). Folds whose training rows lack `least` rows of either of the two most frequent classes are skipped. The loop is over folds, each fit
    and prediction is a distributed job; lineage of long boosting is cut by checkpoints in the shared folder.

    first_too: rows before the first tested fold, which no model can score unseen, are scored by the first model, which was trained on them; `seen` tells
    them apart.
    """
    placed = written(folds(rows, order, splits), "folds")
    context = placed.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(placed.sparkSession))
    lacking = placed.agg(*(F.max((F.col(c).isNull() | F.isnan(c)).cast("int")).alias(c) for c in columns)).first()  # one row
    flagged = [c for c in columns if lacking[c]]
    out, first = None, first_too
    for k in range(1, splits + 1):
        train, test = placed.where(F.col("fold") < k), placed.where(F.col("fold") == k)
        seen = sorted((x["count"] for x in train.groupBy("label").count().collect()), reverse=True)  # a row for each class
        if len(seen) < 2 or seen[1] < least:
            continue
        model = pipeline(columns, kind, missing, size, flagged).fit(weighted(train))
        probs = vector_to_array("probability")
        for part, given in (("train", train), ("test", test))[0 if train_too or first else 1 :]:
            scored = model.transform(given).select(*rows.columns, F.lit(k).alias("fold"), F.lit(part).alias("part"), F.lit(part == "train").alias("seen"), F.get(probs, F.lit(1)).alias("p"), probs.alias("probabilities"), F.col("prediction").cast("int").alias("predicted"))
            out = scored if out is None else out.unionByName(scored)
        first = False
    if out is None:
        out = placed.where("false").withColumns({"part": F.lit("test"), "seen": F.lit(False), "p": F.lit(0.0), "probabilities": F.array(F.lit(0.0)), "predicted": F.lit(0)})
    return out if train_too else out.drop("part") if first_too else out.drop("part", "seen")


def class_report(scored: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each class over all out-of-sample rows, with their plain (`macro`) and supported (`weighted`) means."""
    pairs = scored.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    d = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    own = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n"))).alias("hit"))
    named = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("named"))
    each = own.join(named, "label", "left")
    each = each.withColumns({"precision": ratio(d(F.col("hit")), d(F.col("named"))), "recall": ratio(d(F.col("hit")), d(F.col("support"))), "f1": ratio(2 * d(F.col("hit")), d(F.col("named")) + d(F.col("support")))})
    shown = each.select(F.col("label").cast("string").alias("class"), "support", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("precision", "recall", "f1")))
    total = F.sum("support").cast("long").alias("support")
    macro = shown.agg(total, *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit("macro").alias("class"), "*")
    mean = shown.agg(total, *(F.round(ratio(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), 4).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit("weighted").alias("class"), "*")
    return shown.unionByName(macro).unionByName(mean)


def importances(model: PipelineModel, columns: list[str], spark: SparkSession, top: int = 15) -> DataFrame:
    """The `top` columns that a fitted tree model weighs most: feature, importance, place; ties by name."""
    found = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(columns, found, strict=True)), "feature string, importance double")  # a row for each column of the model
    return rows.orderBy(F.desc("importance"), "feature").limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall and F1 at a threshold by fold, and the exact ROC-AUC by ranks, ties at their middle. Equal probabilities are one
    row with a count, and ranks run over ranges of probabilities, so that no task sees a whole fold.
    """
    scored = written(scored.select("fold", "label", "p"), "scored")
    tp, fp = F.count_if((F.col("p") >= threshold) & (F.col("label") == 1)), F.count_if((F.col("p") >= threshold) & (F.col("label") == 0))
    pos, n = F.count_if(F.col("label") == 1), F.count(F.lit(1))
    values = scored.groupBy("fold", "p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("pos"))
    ranked = running(ranged(values, ["fold", "p"], "ranks"), ["fold"], F.col("_range"), ["p"], {"upto": ("sum", F.col("n"))})
    sums = ranked.groupBy("fold").agg(F.sum(F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2)).alias("mids"))
    d = lambda c: c.cast("double")
    auc = ratio(F.max("mids") - d(pos) * (d(pos) + 1) / 2, d(pos) * d(n - pos))
    return scored.join(sums, "fold").groupBy("fold").agg(n.alias("rows"), pos.alias("positives"), F.round(ratio(d(tp), d(tp + fp)), 4).alias("precision"), F.round(ratio(d(tp), d(pos)), 4).alias("recall"), F.round(ratio(2.0 * d(tp), d(tp + fp + pos)), 4).alias("f1"), F.round(auc, 4).alias("auc"))


def tuned_threshold(scored: DataFrame, r: str = "r_multiple", keep: float = 0.4, steps: int = 31) -> DataFrame:
    """By fold the threshold that its training rows choose, and what it does to the test rows (scored: of walk_forward with train_too).

    Of 31 quantiles of the training rows' p up to 0.9 the one with the largest sum of r among those that keep 40 % of the training rows; the
    lowest on ties. No test row has a say in it.
    """
    scored = written(scored.select("fold", "part", "p", r), "scored")
    train, test = scored.where("part = 'train'"), scored.where("part = 'test'")
    quantiles = percentiles(train, ["fold"], "p", [round(0.9 * i / (steps - 1), 6) for i in range(steps)])
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    levels = quantiles.join(sizes, "fold").select("fold", "n", F.explode(F.array_distinct("q")).alias("threshold"))
    kept = train.join(levels, "fold").where(F.col("p") >= F.col("threshold")).groupBy("fold", "threshold", "n").agg(F.count(F.lit(1)).alias("kept"), F.sum(r).alias("gain"))
    best = kept.where(F.col("kept") >= keep * F.col("n")).groupBy("fold").agg(F.max_by("threshold", F.struct(F.round("gain", 9), -F.col("threshold"))).alias("threshold"))
    taken = F.col("p") >= F.col("threshold")
    return test.join(best, "fold").groupBy("fold", "threshold").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(taken).alias("kept"), F.round(F.sum(r), 4).alias("all_r"), F.round(F.coalesce(F.sum(F.when(taken, F.col(r))), F.lit(0.0)), 4).alias("kept_r")
    ).withColumn("threshold", F.round("threshold", 6))


def outcome_rows(trades: DataFrame, zones: DataFrame) -> DataFrame:
    """Trades with the point-in-time features of their zones, type and structure as numbers, and label (r_multiple > 0)."""
    z = zones.select("symbol", "zone_id", *(F.col(c).cast("double").alias(c) for c in POINT_IN_TIME))
    rows = trades.select("symbol", "zone_id", "type", "structure", "entry_ts", "r_multiple", "outcome").join(z, ["symbol", "zone_id"], "left")
    coded = {"is_demand": recoded(F.col("type") == "demand").cast("double")} | {f"struct_{s}": (F.col("structure") == s).cast("double") for s in ("DBR", "RBD", "RBR", "DBD")}
    return rows.withColumns(coded | {"label": (F.col("r_multiple") > 0).cast("int")})


OUTCOME_FEATURES = [*POINT_IN_TIME, "is_demand", "struct_DBR", "struct_RBD", "struct_RBR", "struct_DBD"]


def shuffled(rows: DataFrame, keys: list[str], r: str = "r_multiple", seed: int = 7) -> DataFrame:
    """rows with their labels permuted over the whole table, by a hash's order, and r turned to the label's sign: a control that must not be
    learnable once a model is fitted and tested on it again.
    """
    from barline.plans.ranks import ranked

    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", *keys, F.lit(seed)).cast("binary")))
    to, _ = ranked(hashed, keys)
    by, _ = ranked(hashed.select("label", "_h", *keys), ["_h", *keys])
    out = to.drop("label", "_h").join(by.select("label", "rank"), "rank").drop("rank")
    return out.withColumn(r, F.abs(r) * F.when(F.col("label") == 1, 1.0).otherwise(-1.0))


#: Classes of a bar: the structure of the zone that forms on it, or none; and what a model sees of it.
CLASSES = ["no_zone", "DBR", "RBD", "RBR", "DBD"]
STRUCTURE_FEATURES = [
    *(f"ema{n}_dist" for n in (20, 50, 200)), "nearest_demand_dist_pct", "nearest_supply_dist_pct", "active_demand_count", "active_supply_count", "price_in_demand_zone", "price_in_supply_zone", "zone_confluence",
    "volume_ratio", "body_to_atr", "range_to_atr", "rolling_volatility", "is_bullish",
]


def structure_rows(labelled: DataFrame) -> DataFrame:
    """Bars with their context (`labels.label`) as rows of five classes: symbol, ts, label (the class's number) and features; a distance that no
    zone gives is 999.
    """
    far = {f"ema{n}_dist": ratio(F.col("close") - F.col(f"ema{n}"), F.col("atr")) for n in (20, 50, 200)}
    given = {c: F.coalesce(c, F.lit(999.0)) for c in ("nearest_demand_dist_pct", "nearest_supply_dist_pct")}
    named = F.coalesce("zone_formed_structure", F.lit(CLASSES[0]))
    rows = labelled.where("atr is not null").withColumns(far | given).withColumn("label", (F.array_position(F.array(*(F.lit(c) for c in CLASSES)), named) - 1).cast("int"))
    return rows.select("symbol", "ts", "label", *(F.col(c).cast("double").alias(c) for c in STRUCTURE_FEATURES))


def score_zones(zones: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds ml_prob, 1 less the probability of no zone on the zone's formation bar (null where no bar is scored), and ml_rank: descending,
    ties in order of zone_id, null without a probability.
    """
    probs = scored.select("symbol", F.col("ts").alias("formation_ts"), (1 - F.get("probabilities", F.lit(0))).alias("ml_prob"))
    out = zones.join(probs.dropDuplicates(["symbol", "formation_ts"]), ["symbol", "formation_ts"], "left")
    return ranks(out)


def ranks(zones: DataFrame) -> DataFrame:
    """Adds ml_rank within the symbol by falling ml_prob."""
    placed = numbered(zones, ["symbol"], [F.desc_nulls_last("ml_prob"), "zone_id"], "ml_rank")
    return placed.withColumn("ml_rank", F.when(F.col("ml_prob").isNotNull(), F.col("ml_rank").cast("int")))
