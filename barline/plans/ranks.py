"""Ranks over a whole table without one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.sources.shared import written


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with rank (from 1, by order), and their count: ranges are sorted apart and shifted by the counts of those before. The ranges are
    written out, so that a lost executor can't draw them anew.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_k", inside).join(F.broadcast(before), "_part").withColumn("rank", F.col("_k") + F.col("_before"))
    return out.drop("_part", "_n", "_before", "_k"), dealt.count()
