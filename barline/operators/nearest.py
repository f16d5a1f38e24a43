"""The nearest price interval as of a time, and whether one overlaps, without pairing intervals with each other.

Intervals (longer zones) are never given up, so that of those that hold a price the one formed first answers for all times: a tree over prices
keeps at each node the first formed interval that covers it, and a price asks the nodes above it. Intervals beside the price are two series, by
their lower ends upwards and by their upper ends downwards, in which the first one formed in time is a first hit of the pyramid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.expr import ratio
from barline.functions.scans import ranged, running
from barline.operators.history import Pyramid
from barline.sources.shared import written

#: Children of a node in the tree over prices; how far a bound is loosened before the exact test of what it finds.
CHILDREN, SLACK = 8, 1e-9


def tiles(first: Column, end: Column, fan: int = CHILDREN) -> Column:
    """The nodes strictly between a level's nodes `first` and `end` that lie under the parents of either: over all levels they tile what lies between."""
    none = F.array().cast("array<bigint>")
    upto = F.least((F.floor(first / fan) + 1) * fan, end) - 1
    since = F.greatest(F.floor(end / fan) * fan, first + 1)
    some = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(none)
    return F.array_distinct(F.concat(some(first + 1, upto), some(since, end - 1)))


def _levels(most: int, fan: int = CHILDREN) -> int:
    k = 0
    while fan ** (k + 1) <= most:
        k += 1
    return k


def _width() -> Column:
    return F.pow(F.lit(float(CHILDREN)), "level").cast("long")


def _held(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """points: group, key, v. group, key and x, the first formed interval that holds v (ends included); none without one."""
    ends = intervals.select("group", F.explode(F.array("bottom", "top")).alias("v")).distinct().withColumns({"kind": F.lit(0), "key": F.lit(None).cast(points.schema["key"].dataType)})
    series = ranged(ends.unionByName(points.select("group", "key", "v").withColumn("kind", F.lit(1))), ["group", "v", "kind"], "prices")
    coordinate = F.col("kind") == 0
    placed = written(running(series, ["group"], F.col("_range"), ["v", "kind"], {"n": ("sum", F.when(coordinate, 1).otherwise(0).cast("long")), "end": ("last", F.when(coordinate, F.col("v")))}), "cells")
    # cells: an end itself is an odd one, what lies between two ends an even one
    cell = placed.withColumn("cell", 2 * F.coalesce("n", F.lit(0)) - F.when(F.col("end") == F.col("v"), 1).otherwise(0))
    at = cell.where("kind = 0").select("group", "v", "cell")
    spans = intervals.join(at.withColumnsRenamed({"v": "bottom", "cell": "low"}), ["group", "bottom"]).join(at.withColumnsRenamed({"v": "top", "cell": "high"}), ["group", "top"])
    levels = F.explode(F.sequence(F.lit(0), F.lit(_levels(2 * (placed.agg(F.max("n")).first()[0] or 0) + 2))))
    nodes = spans.withColumn("level", levels).withColumn("node", F.explode(tiles(F.floor((F.col("low") - 1) / _width()), F.floor((F.col("high") + 1) / _width()))))
    best = nodes.groupBy("group", "level", "node").agg(F.min(F.struct("formed", "id", "top", "bottom")).alias("x"))
    asked = cell.where("kind = 1").withColumn("level", levels).withColumn("node", F.floor(F.col("cell") / _width()))
    return asked.join(best, ["group", "level", "node"]).groupBy("group", "key").agg(F.min("x").alias("x"))


def _series(intervals: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intervals with idx, their place by lower end upwards (way 1) and by upper end downwards (way -1), and bounds (group, key, way, v, ...) with `upto`, how
    many of a way's ends lie at v or before."""
    both = intervals.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("v", F.when(F.col("way") == 1, F.col("bottom")).otherwise(-F.col("top")))
    extra = [c for c in bounds.columns if c not in ("group", "way", "v")]
    rows = both.withColumn("kind", F.lit(0)).unionByName(bounds.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = ranged(rows, ["group", "way", "v", "kind"], "series")
    placed = written(running(dealt, ["group", "way"], F.col("_range"), ["v", "kind", "formed", "id"], {"upto": ("sum", F.when(F.col("kind") == 0, 1).otherwise(0).cast("long"))}), "series_places")
    return placed.where("kind = 0").withColumn("idx", F.col("upto") - 1).select("group", "way", "idx", "formed", "id", "top", "bottom"), placed.where("kind = 1").select("group", "way", *extra, "upto")


def nearest(asked: DataFrame, intervals: DataFrame, least: float) -> DataFrame:
    """asked: group, key, at (a price), low and high (its own interval), upto (a time); intervals: group, id, top, bottom, formed. Returns group, key, gap (from `at` to
    the nearest interval formed by then, 0 inside), id of it (ties: the first formed, then by id), held (an interval holds `at`), agrees (one overlaps the own
    interval by a share of `least` of its height).

    For `agrees` the first formed interval that holds the own one's inner lower bound, or the first hit among those that begin within it, decides; where the
    former is too thin the exact pairs of that question alone are looked at.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    asked = written(asked.withColumns({"t": seconds("upto"), "inner": F.col("low") + least * (F.col("high") - F.col("low")) - SLACK, "outer": F.col("high") - least * (F.col("high") - F.col("low")) + SLACK}), "asked")
    intervals = written(intervals, "intervals")
    points = asked.select("group", F.explode(F.array(F.struct(F.struct("key", F.lit("at").alias("what")).alias("key"), F.col("at").alias("v")), F.struct(F.struct("key", F.lit("inner").alias("what")).alias("key"), F.col("inner").alias("v")))).alias("p")).select("group", "p.*")
    held = written(_held(intervals, points).select("group", "key.*", "x"), "held")

    def bound(way: int, what: str, v: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), F.lit(what).alias("what"), v.alias("v"))

    bounds = asked.select("group", "key", F.explode(F.array(bound(1, "at", F.col("at")), bound(-1, "at", -F.col("at")), bound(1, "inner", F.col("inner")), bound(1, "outer", F.col("outer")))).alias("b")).select("group", "key", "b.*")
    series, bounds = _series(intervals, bounds)
    named = lambda df: df.withColumn("symbol", F.concat_ws("/", "group", "way"))
    height = F.col("top") - F.col("bottom")
    tree = Pyramid(named(series).select("symbol", "idx", F.col("formed").alias("ts"), seconds("formed").alias("low"), height.alias("high"), F.lit(0.0).alias("close")))
    wide = bounds.groupBy("group", "key").agg(*(F.max(F.when((F.col("what") == w) & (F.col("way") == k), F.col("upto"))).alias(n) for w, k, n in (("at", 1, "above"), ("at", -1, "below"), ("inner", 1, "inside"), ("outer", 1, "outside"))))
    questions = asked.join(wide, ["group", "key"])
    beside = questions.select("group", "key", "t", F.explode(F.array(F.struct(F.lit(1).alias("way"), (F.col("above") - 1).alias("after")), F.struct(F.lit(-1).alias("way"), (F.col("below") - 1).alias("after")))).alias("q")).select("group", "key", "t", "q.*")
    found = tree.first(named(beside), lambda: F.col("low") <= F.col("t")).select("group", "key", "way", F.col("at").alias("idx")).join(series, ["group", "way", "idx"])
    inside = held.where("what = 'at'").select("group", "key", F.col("x.id").alias("id"), F.col("x.formed").alias("formed"), F.col("x.top").alias("top"), F.col("x.bottom").alias("bottom"))
    every = found.select("group", "key", "id", "formed", "top", "bottom").unionByName(inside).join(asked.select("group", "key", "at", "upto"), ["group", "key"]).where(F.col("formed") <= F.col("upto"))
    gap = F.greatest(F.col("bottom") - F.col("at"), F.col("at") - F.col("top"), F.lit(0.0))
    best = every.withColumn("gap", gap).groupBy("group", "key").agg(F.min(F.struct("gap", "formed", "id")).alias("n"))

    enough = ratio(F.least("high", "top") - F.greatest("low", "bottom"), F.col("high") - F.col("low")) >= least
    covering = held.where("what = 'inner'").select("group", "key", F.col("x.formed").alias("formed"), F.col("x.top").alias("top"), F.col("x.bottom").alias("bottom")).join(asked, ["group", "key"]).where(F.col("formed") <= F.col("upto")).withColumn("ok", enough)
    begun = questions.where("inside < outside").select("group", "key", F.lit(1).alias("way"), "t", (least * (F.col("high") - F.col("low")) - SLACK).alias("need"), (F.col("inside") - 1).alias("after"), F.col("outside").alias("before"))
    begun = tree.first(named(begun), lambda: (F.col("low") <= F.col("t")) & (F.col("high") >= F.col("need")), exact=False).select("group", "key", "way", F.col("at").alias("idx")).join(series, ["group", "way", "idx"]).join(asked, ["group", "key"]).withColumn("ok", enough)
    judged = written(covering.select("group", "key", "ok").unionByName(begun.select("group", "key", "ok")).groupBy("group", "key").agg(F.bool_or("ok").alias("ok")), "judged")
    others = intervals.withColumnRenamed("group", "of")
    doubtful = judged.where("not ok").select("group", "key").join(asked, ["group", "key"]).join(others, (F.col("group") == F.col("of")) & (F.col("formed") <= F.col("upto")) & (F.col("bottom") <= F.col("outer")) & (F.col("top") >= F.col("inner"))).where(enough)
    agrees = judged.where("ok").select("group", "key").unionByName(doubtful.select("group", "key")).distinct().withColumn("agrees", F.lit(True))
    return asked.select("group", "key").join(best, ["group", "key"], "left").join(agrees, ["group", "key"], "left").select("group", "key", "n.gap", "n.id", F.coalesce(F.col("n.gap") == 0, F.lit(False)).alias("held"), F.coalesce("agrees", F.lit(False)).alias("agrees"))
