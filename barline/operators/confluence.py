"""Confluence of zones with those of a longer unit, as of formation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import ZoneConfig
from barline.functions.expr import clip, ratio
from barline.functions.scans import placed, running
from barline.operators import zones as zone_ops
from barline.operators.history import Pyramid
from barline.operators.indicators import with_indicators
from barline.operators.nearest import nearest
from barline.sources.bars import resample
from barline.sources.shared import written


def higher(bars: DataFrame, hours: int | None = None) -> DataFrame:
    """Bars of the longer unit with indicators, without warm-up; close_ts is the last bar each one knows."""
    longer = resample(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), hours=hours)
    made = with_indicators(longer.drop("last_ts")).join(longer.select("symbol", "ts", F.col("last_ts").alias("close_ts")), ["symbol", "ts"])
    return written(placed(made.where("atr is not null").drop("idx")), "longer")


def confluence(found: DataFrame, longer: DataFrame, z: ZoneConfig = ZoneConfig()) -> DataFrame:
    """Adds htf_trend_align, htf_in_zone, htf_dist_atr, htf_zone_strength, htf_zone_fresh, htf_confluence and htf_confirmed.

    Only longer bars that have closed by a zone's formation count. No zone is paired with all longer ones (`nearest`). The nearest longer zone of the same type decides, the earlier one on
    ties; without one the distance and strength are null and the flags false.
    """
    own = found.select("symbol", "zone_id", "type", "top", "bottom", "midpoint", "avg_atr", "formation_ts", "formation_idx")
    # as of formation: both in one sorted pass, each zone takes over the last longer bar before it
    seen = longer.select("symbol", F.col("close_ts").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("zone_id"), F.struct("close", "ema20", F.col("atr").alias("h_atr"), F.col("idx").cast("long").alias("h_idx")).alias("w"))
    asked = own.select("symbol", F.col("formation_ts").alias("t"), F.lit(1).alias("kind"), "zone_id", F.lit(None).cast(seen.schema["w"].dataType).alias("w"))
    both = running(seen.union(asked), ["symbol"], F.col("t").cast("date"), ["t", "kind"], {"last": ("last", F.col("w"))})
    last = both.where("kind = 1").select("symbol", "zone_id", F.col("last").alias("w"))
    hz = written(zone_ops.scored_zones(longer, z), "longer_zones")
    closes = longer.select("symbol", F.col("idx").alias("formation_idx"), F.col("close_ts").alias("h_formed"))
    group = F.concat_ws("/", "symbol", "type").alias("group")
    hz = written(hz.join(closes, ["symbol", "formation_idx"]).select(group, "zone_id", "top", "bottom", "strength", "h_formed", F.col("formation_idx").cast("long").alias("h_idx")), "longer_zones")
    questions = own.select(group, F.struct("symbol", "zone_id").alias("key"), F.col("midpoint").alias("at"), F.col("bottom").alias("low"), F.col("top").alias("high"), F.col("formation_ts").alias("upto"))
    near = nearest(questions, hz.select("group", F.col("zone_id").alias("id"), "top", "bottom", F.col("h_formed").alias("formed")), z.htf_overlap)
    n = F.when(F.col("id").isNotNull(), F.struct("gap", F.col("strength").alias("h_strength"), F.col("top").alias("h_top"), F.col("bottom").alias("h_bottom"), "h_idx")).alias("n")
    best = written(near.join(hz.withColumnRenamed("zone_id", "id"), ["group", "id"], "left").select("key.*", n, "held", "agrees"), "nearest")
    # whether a longer bar has met the nearest one since
    since = best.where("n is not null").join(last, ["symbol", "zone_id"]).select("symbol", "zone_id", F.col("n.h_top").alias("top"), F.col("n.h_bottom").alias("bottom"), F.col("n.h_idx").alias("after"), (F.col("w.h_idx") + 1).alias("before"))
    touches = Pyramid(longer).first(since, zone_ops.overlapping, exact=False).select("symbol", "zone_id", F.lit(1).alias("touches"))
    out = found.join(last, ["symbol", "zone_id"], "left").join(best, ["symbol", "zone_id"], "left").join(touches, ["symbol", "zone_id"], "left")
    side = F.when(F.col("type") == "demand", 1.0).otherwise(-1.0)
    dist = F.col("n.gap") / F.col("avg_atr")
    out = out.withColumns(
        {
            "htf_trend_align": F.round(side * ratio(F.col("w.close") - F.col("w.ema20"), F.col("w.h_atr")), 4),
            "htf_in_zone": F.coalesce("held", F.lit(False)),
            "htf_dist_atr": F.round(dist, 4),
            "htf_zone_strength": F.col("n.h_strength"),
            "htf_zone_fresh": F.col("n").isNotNull() & (F.coalesce("touches", F.lit(0)) == 0),
            "htf_confirmed": F.coalesce("agrees", F.lit(False)),
        }
    )
    trend = F.when(F.col("htf_trend_align").isNull(), 0.5).otherwise(clip(0.5 + F.col("htf_trend_align") / 4))
    score = (
        0.30 * F.col("htf_in_zone").cast("double")
        + 0.25 * F.coalesce(clip(1 - F.col("htf_dist_atr") / 2), F.lit(0.0))
        + 0.20 * F.coalesce("htf_zone_strength", F.lit(0.0))
        + 0.15 * trend
        + 0.10 * F.col("htf_zone_fresh").cast("double")
    )
    return out.withColumn("htf_confluence", F.round(score + 1e-9, 4)).drop("w", "n", "held", "agrees", "touches")
