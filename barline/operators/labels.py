"""Zone context of every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.history import Pyramid
from barline.functions.scans import placed, running
from barline.operators.nearest import tiles
from barline.operators.zones import overlapping
from barline.sources.shared import written

STRUCTURES = ("DBR", "RBD", "RBR", "DBD")


def prepared(zones: DataFrame) -> DataFrame:
    """Zones of known structures, with zone_strength: strength_pit where there is one."""
    given = [F.col(c) for c in ("strength_pit", "strength") if c in zones.columns]
    return zones.where(F.col("structure").isin(*STRUCTURES)).withColumn("zone_strength", F.coalesce(*given))


def formations(bars: DataFrame, zones: DataFrame, winner: str = "strongest") -> DataFrame:
    """Adds the zone formed on each bar (of several the strongest, or the `first` by base) and their count, and flags by structure."""
    order = [F.desc_nulls_last("zone_strength"), "zone_id"] if winner == "strongest" else ["base_start_idx", "zone_id"]
    by = Window.partitionBy("symbol", "formation_ts")
    z = prepared(zones).withColumns({"place": F.row_number().over(by.orderBy(*order)), "formed": F.count(F.lit(1)).over(by)}).where("place = 1")
    z = z.select("symbol", F.col("formation_ts").alias("ts"), F.col("structure").alias("zone_formed_structure"), F.col("type").alias("zone_formed_type"), F.col("zone_strength").alias("zone_formed_strength"), F.col("formed").alias("zone_formed_count"))
    out = bars.join(z, ["symbol", "ts"], "left").withColumns({"zone_formed_strength": F.coalesce("zone_formed_strength", F.lit(0.0)), "zone_formed_count": F.coalesce("zone_formed_count", F.lit(0))})
    return out.withColumns({f"is_{s}": F.coalesce((F.col("zone_formed_structure") == s).cast("int"), F.lit(0)) for s in STRUCTURES})


#: Bars of a stretch, which shares its candidates; children of a node in the tree of stretches.
STRETCH, CHILDREN = 64, 8


def _lives(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """zones with born and dies, the places of the first bars at or after formation and invalidation; dies is null while a zone lives."""
    stamps = zones.select("symbol", "zone_id", F.explode(F.array(F.struct(F.lit("born").alias("what"), F.col("formation_ts").alias("ts")), F.struct(F.lit("dies").alias("what"), F.col("invalidation_ts").alias("ts")))).alias("s")).select("symbol", "zone_id", "s.*").where("ts is not null")
    both = bars.select("symbol", F.lit(None).cast("string").alias("zone_id"), F.lit(None).cast("string").alias("what"), "ts", F.lit(1).alias("bar")).unionByName(stamps.withColumn("bar", F.lit(0)))
    places = running(both, ["symbol"], F.col("ts").cast("date"), ["ts", "bar"], {"place": ("sum", F.col("bar"))}).where("bar = 0")
    wide = places.groupBy("symbol", "zone_id").agg(F.max(F.when(F.col("what") == "born", F.col("place"))).alias("born"), F.max(F.when(F.col("what") == "dies", F.col("place"))).alias("dies"))
    return zones.join(wide, ["symbol", "zone_id"]).where("dies is null or born < dies")


def _counts(bars: DataFrame, lives: DataFrame) -> DataFrame:
    """symbol, idx, active_demand_count, active_supply_count: births less deaths up to each bar."""
    events = lives.select("symbol", "type", F.explode(F.array(F.struct(F.col("born").alias("idx"), F.lit(1).alias("n")), F.struct(F.col("dies").alias("idx"), F.lit(-1).alias("n")))).alias("e")).select("symbol", "type", "e.*").where("idx is not null")
    moves = events.groupBy("symbol", "idx").agg(*(F.sum(F.when(F.col("type") == t, F.col("n"))).alias(t) for t in ("demand", "supply")))
    each = bars.select("symbol", "idx").join(moves, ["symbol", "idx"], "left")
    counted = running(each, ["symbol"], F.floor(F.col("idx") / 4096), ["idx"], {f"active_{t}_count": ("sum", F.coalesce(t, F.lit(0)).cast("long")) for t in ("demand", "supply")})
    return counted.drop("demand", "supply")


def _beside(stretches: DataFrame, lives: DataFrame) -> DataFrame:
    """symbol, stretch, zone_id: of the zones that live through a whole stretch the nearest ones below and above all its closes, as seen by their type.

    A tree over the stretches holds each zone at the few nodes that tile its life. A stretch asks the nodes above it; in each, zones and questions
    are one series by price, in which a question takes over the zone before it.
    """
    most = stretches.agg(F.max("stretch")).first()[0] or 0
    levels = 1
    while CHILDREN**levels <= most:
        levels += 1
    width = F.pow(F.lit(float(CHILDREN)), "level").cast("long")
    z = lives.withColumns({"first": F.floor(F.col("born") / STRETCH), "end": F.coalesce(F.floor(F.col("dies") / STRETCH), F.lit(CHILDREN**levels))}).where("end > first + 1").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    own, stop = F.floor(F.col("first") / width), F.floor(F.col("end") / width)  # what lies between them on a level, under the parents of either, is the tile
    z = z.withColumn("node", F.explode(tiles(own, stop, CHILDREN)))
    side = lambda c: F.when(F.col("type") == "demand", c).otherwise(-c)
    both = F.explode(F.array(F.lit(1), F.lit(-1))).alias("way")  # 1: the nearest below, -1: the nearest above
    edge = side(F.when(F.col("type") == "demand", F.col("top")).otherwise(F.col("bottom")))
    held = z.select("symbol", "type", "level", "node", both, edge.alias("edge"), "formation_ts", "zone_id").select("*", (F.col("edge") * F.col("way")).alias("v"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("stretch"))
    asked = stretches.withColumn("type", F.explode(F.array(F.lit("demand"), F.lit("supply")))).select("symbol", "stretch", "type", "low_close", "high_close", both)
    least, greatest = F.least(side(F.col("low_close")), side(F.col("high_close"))), F.greatest(side(F.col("low_close")), side(F.col("high_close")))
    asked = asked.withColumn("v", F.when(F.col("way") == 1, least).otherwise(-greatest)).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("node", F.floor(F.col("stretch") / width))
    asked = asked.select("symbol", "type", "level", "node", "way", F.lit(None).cast("double").alias("edge"), F.lit(None).cast(held.schema["formation_ts"].dataType).alias("formation_ts"), F.lit(None).cast("string").alias("zone_id"), "v", F.lit(0).alias("kind"), "stretch")
    unit = stretches.groupBy("symbol").agg((8 * F.avg(F.col("high_close") - F.col("low_close")) + 1e-9).alias("unit"))
    series = written(held.unionByName(asked).join(unit, "symbol"), "beside")
    zone = F.when(F.col("kind") == 1, F.struct("v", "formation_ts", "zone_id"))
    keys = ["symbol", "type", "level", "node", "way"]
    # questions come before zones of their price; of zones of one price the earliest comes last
    met = running(series, keys, F.floor(F.col("v") / F.col("unit")), ["v", "kind", F.desc("formation_ts"), F.desc("zone_id")], {"z": ("last", zone)}).where("kind = 0 and z is not null")
    nearest = met.groupBy("symbol", "stretch", "type", "way").agg(F.min_by("z.zone_id", F.struct(-F.col("z.v"), "z.formation_ts", "z.zone_id")).alias("zone_id"))
    return nearest.select("symbol", "stretch", "zone_id")


def context(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds counts of active zones, the nearest demand and supply zone, and whether the close lies in one.

    A zone is active from its formation, not on its invalidation bar. Nearest: the smallest distance among zones on the expected side
    of the close, else the smallest distance at all; the earlier zone on ties.

    Counts are running sums of births and deaths. For the nearest, bars are taken in stretches: a bar's answer is a zone that is born or dies in its
    stretch, or whose range meets the stretch's closes, or the nearest one below or above all of them. So the rows made grow with bars, zones
    and the stretches in which price meets a zone, not with the bars of zones' lives.
    """
    b = written((bars if "idx" in bars.columns else placed(bars)).select("symbol", "ts", "close", F.col("idx").cast("long").alias("idx")).withColumn("stretch", F.floor(F.col("idx") / STRETCH)), "context_bars")
    z = prepared(zones).select("symbol", "zone_id", "type", "structure", "top", "bottom", "zone_strength", "formation_ts", "invalidation_ts")
    lives = written(_lives(b, z), "lives")
    stretches = b.groupBy("symbol", "stretch").agg(F.min("close").alias("low_close"), F.max("close").alias("high_close"), F.min("ts").alias("ts"))
    ends = lives.select("symbol", "zone_id", F.explode(F.array(F.floor(F.col("born") / STRETCH), F.floor(F.col("dies") / STRETCH))).alias("stretch")).where("stretch is not null")
    tree = Pyramid(stretches.select("symbol", F.col("stretch").alias("idx"), "ts", F.col("low_close").alias("low"), F.col("high_close").alias("high"), F.col("low_close").alias("close")))
    asked = lives.select("symbol", "zone_id", "top", "bottom", F.floor(F.col("born") / STRETCH).alias("after"), F.floor(F.col("dies") / STRETCH).alias("before"))
    met = tree.hits(asked, overlapping).select("symbol", F.col("at").alias("stretch"), "zone_id")
    near = ends.unionByName(met).unionByName(_beside(stretches, lives)).distinct()
    live = (F.col("born") <= F.col("idx")) & (F.col("dies").isNull() | (F.col("idx") < F.col("dies")))
    dist = F.when(F.col("type") == "demand", F.col("close") - F.col("top")).otherwise(F.col("bottom") - F.col("close"))
    pairs = near.join(lives.drop("invalidation_ts"), ["symbol", "zone_id"]).join(b, ["symbol", "stretch"]).where(live).withColumns({"dist": dist, "within": (F.col("bottom") <= F.col("close")) & (F.col("close") <= F.col("top"))})
    rank = F.struct(F.when(F.col("dist") >= 0, 0).otherwise(1), F.abs(F.col("dist")), F.col("formation_ts"), F.col("zone_id"))
    aggs = []
    for t in ("demand", "supply"):
        one = F.col("type") == t
        edge = ("top", "bottom") if t == "demand" else ("bottom", "top")
        aggs += [F.min_by(F.when(one, F.struct(*edge, "dist", "zone_strength", "structure")), F.when(one, rank)).alias(t), F.max(F.when(one, F.col("within").cast("int"))).alias(f"price_in_{t}_zone")]
    seen = pairs.groupBy("symbol", "ts").agg(*aggs)
    counts = _counts(b, lives).join(b.select("symbol", "idx", "ts"), ["symbol", "idx"]).drop("idx")
    out = bars.join(counts, ["symbol", "ts"]).join(seen, ["symbol", "ts"], "left")
    for t in ("demand", "supply"):
        out = out.withColumns(
            {
                f"price_in_{t}_zone": F.coalesce(f"price_in_{t}_zone", F.lit(0)),
                f"nearest_{t}_top": F.col(f"{t}.top"),
                f"nearest_{t}_bottom": F.col(f"{t}.bottom"),
                f"nearest_{t}_dist_pct": F.round(100 * F.col(f"{t}.dist") / F.col("close"), 4),
                f"nearest_{t}_strength": F.col(f"{t}.zone_strength"),
                f"nearest_{t}_structure": F.col(f"{t}.structure"),
            }
        ).drop(t)
    return out.withColumn("zone_confluence", ((F.col("active_demand_count") > 0) & (F.col("active_supply_count") > 0)).cast("int"))


def label(bars: DataFrame, zones: DataFrame, winner: str = "strongest") -> DataFrame:
    return context(formations(bars, zones, winner), zones)


def formed(labelled: DataFrame) -> DataFrame:
    """The bars on which a zone formed."""
    columns = ["symbol", "ts", "close", "zone_formed_structure", "zone_formed_type", "zone_formed_strength", "zone_formed_count", "active_demand_count", "active_supply_count", "zone_confluence"]
    return labelled.where("zone_formed_count > 0").select(columns)
