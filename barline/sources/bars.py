"""Bars, zones and trades from ticks and files, and back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.scans import placed, running

#: Schema of bar files; a Date column is renamed to ts by the reader.
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Schema of zone files: the five dates, whatever else they hold.
ZONE_DATES = ["formation_ts", "base_start_ts", "base_end_ts", "last_test_ts", "invalidation_ts"]
ZONES = "symbol string, zone_id string, type string, structure string, top double, bottom double, proximal double, distal double, strength double, strength_pit double, ml_prob double"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, event_id, v (cents): the moves that `events` stands for."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))


def ohlc(moves: DataFrame, unit: str = "hour", start: int = 10_000_000) -> DataFrame:
    """Bars of a price in cents that starts at `start` and moves by +v or -v (even or odd event_id) at each tick.

    The running price is a prefix sum in two levels: within each bar, where no task sees more than a bar, and over the bars' sums. Both
    are exact integers. Null ts or symbol: left out.
    """
    step = F.when(F.col("event_id") % 2 == 0, F.col("v")).otherwise(-F.col("v"))
    each = moves.where("symbol is not null and ts is not null").select("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bar"), "ts", "event_id", "v", step.alias("step"))
    inside = Window.partitionBy("symbol", "bar").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct("ts", "event_id")
    bars = (
        each.withColumn("p", F.sum("step").over(inside))
        .groupBy("symbol", "bar")
        .agg(F.min_by("p", order).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", order).alias("c"), F.sum("v").alias("v"), F.sum("step").alias("net"))
    )
    bars = running(bars, ["symbol"], F.col("bar").cast("date"), ["bar"], {"upto": ("sum", F.col("net"))})
    before = F.col("upto") - F.col("net") + start
    price = lambda c: ((F.col(c) + F.col("before")) / 100.0)
    return bars.withColumn("before", before).select(
        "symbol", F.col("bar").alias("ts"), price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("v").cast("double").alias("volume")
    )


def bars_from_events(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return ohlc(ticks(spark, sf_dir), unit)


def indexed(bars: DataFrame) -> DataFrame:
    """Adds idx, the bar's place within its symbol from 0; of several bars of one ts the last in order of all columns stays."""
    same = Window.partitionBy("symbol", "ts").orderBy(*(F.desc(c) for c in ("volume", "close", "open", "high", "low")))
    one = bars.withColumn("place", F.row_number().over(same)).where("place = 1").drop("place")
    return placed(one.drop("idx"))


def resample(bars: DataFrame, unit: str = "week", hours: int | None = None) -> DataFrame:
    """Bars of a longer unit: weeks that end on Friday, or `hours` long. Bars without a close are left out; ts is the unit's last day or start."""
    when = F.next_day(F.date_sub(F.col("ts").cast("date"), 1), "FRI").cast("timestamp_ntz") if hours is None else F.window(F.col("ts").cast("timestamp"), f"{hours} hours").start.cast("timestamp_ntz")
    grouped = bars.where("close is not null").withColumn("unit", when).groupBy("symbol", "unit")
    made = grouped.agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.max("ts").alias("last_ts"))
    return made.withColumnRenamed("unit", "ts")


def read_csv(spark: SparkSession, path: str, schema: str = BARS, date: str = "Date") -> DataFrame:
    """CSV files with a header; offsets of time zones are stripped, so that stamps stay as they are written."""
    plain = spark.read.option("header", True).csv(path)
    names = {c: ("ts" if c == date else c.lower()) for c in plain.columns}
    plain = plain.toDF(*names.values())
    out = []
    for part in schema.split(","):
        name, kind = (x.strip("`") for x in part.split())
        given = F.col(name) if name in plain.columns else F.lit(None)
        if kind == "timestamp_ntz":
            given = F.regexp_replace(given, r"([+-]\d\d:?\d\d|Z)$", "")
        out.append((F.expr(f"try_cast(`{name}` as {kind})") if name in plain.columns and kind != "timestamp_ntz" else given.cast(kind)).alias(name))
    return plain.select(out)


def regular(bars: DataFrame, unit: str = "hour") -> DataFrame:
    """bars with a row for every unit between a symbol's first and last one; what is new is null."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("ts"))
    return grid.join(bars, ["symbol", "ts"], "left")


def read_zones(spark: SparkSession, path: str, ml_path: str | None = None) -> DataFrame:
    """Zone files with their five dates; with ml_path those of a model instead, whose probability stands in for a strength that no zone of a
    symbol has.
    """
    schema = f"{ZONES}, " + ", ".join(f"{d} timestamp_ntz" for d in ZONE_DATES)
    return scored(read_csv(spark, ml_path or path, schema, date=""))


#: Columns of a table of labelled bars beside symbol, ts, prices and indicators, and of windows beside their features, by type.
LABELLED = {
    "string": ["zone_formed_structure", "zone_formed_type", "nearest_demand_structure", "nearest_supply_structure"],
    "int": ["zone_formed_count", "active_demand_count", "active_supply_count", "price_in_demand_zone", "price_in_supply_zone", "zone_confluence", "is_bullish"],
    "double": ["zone_formed_strength", *(f"nearest_{t}_{x}" for t in ("demand", "supply") for x in ("top", "bottom", "dist_pct", "strength"))],
}


def read_labelled(spark: SparkSession, path: str, indicators: list[str]) -> DataFrame:
    """Files of bars with their zone context (`labels.label`) and the named indicators, in order of symbol and ts."""
    typed = [f"{c} {t}" for t, cs in LABELLED.items() for c in cs if c not in indicators]
    return read_csv(spark, path, ", ".join([BARS, *typed, *(f"{c} double" for c in indicators)]))


def read_windows(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Files of labelled windows: symbol, ts, label, zone_type and the named features."""
    return read_csv(spark, path, ", ".join(["symbol string, ts timestamp_ntz, label int, zone_type string", *(f"`{c}` double" for c in features)]))


def write_names(spark: SparkSession, names: list[str], path: str) -> None:
    """A list of feature names as text, one a line, in order."""
    spark.createDataFrame([("\n".join(names),)], "names string").coalesce(1).write.mode("overwrite").text(path)


def read_names(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path, wholetext=False).collect()]


def scored(zones: DataFrame) -> DataFrame:
    """strength_pit, taken from ml_prob for symbols where no zone has it."""
    from barline.functions.expr import missing

    zones = missing(zones, strength_pit="double", ml_prob="double")
    none = F.count("strength_pit").over(Window.partitionBy("symbol")) == 0
    return zones.withColumn("strength_pit", F.when(none, F.col("ml_prob")).otherwise(F.col("strength_pit")))


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A table partitioned by symbol where it has one; kind csv keeps a header."""
    writer = df.write.mode("overwrite")
    if "symbol" in df.columns and len(df.columns) > 1:
        writer = writer.partitionBy("symbol")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
