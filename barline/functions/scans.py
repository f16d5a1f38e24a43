"""Running values, ranks and selections in two levels, so that no task sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.sources.shared import written

#: What a running value adds up and how what came before joins it.
_OVER = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_JOIN = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "last": lambda a, b: F.coalesce(b, a)}
_JOIN["count"] = _JOIN["sum"]


def running(rows: DataFrame, keys: list[str], piece: Column, order: list, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds running values of each key's rows in order, the own row included: name -> (sum, count, max, min or last that isn't null; column).

    piece: any column that never falls along the order (a block of places, a day, a range of prices). Values run within pieces, in parallel, and
    take over those of the pieces before, which are a row each. Sums of whole numbers are exact; nulls count for nothing.
    """
    marked = rows.withColumn("_piece", piece)
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    if any(kind == "last" for kind, _ in values.values()):  # the last of a piece needs its order, too
        marked = marked.withColumns({f"_{n}": _OVER[k](c).over(upto) for n, (k, c) in values.items()}).withColumn("_nth", F.row_number().over(inside))
        totals = marked.groupBy(*keys, "_piece").agg(*(F.max_by(f"_{n}", "_nth").alias(f"_{n}") for n in values))
        marked = marked.drop("_nth")
    else:
        totals = marked.groupBy(*keys, "_piece").agg(*(_OVER[k](c).alias(f"_{n}") for n, (k, c) in values.items()))
        marked = marked.withColumns({f"_{n}": _OVER[k](c).over(upto) for n, (k, c) in values.items()})
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "_piece", *(_OVER[k](f"_{n}").over(before).alias(f"^{n}") for n, (k, _) in values.items()))
    out = marked.join(carried.withColumnsRenamed({c: f"^^{c}" for c in [*keys, "_piece"]}), _same([*keys, "_piece"]))
    out = out.withColumns({n: _JOIN[k](F.col(f"`^{n}`"), F.col(f"_{n}")) for n, (k, _) in values.items()})
    return out.drop("_piece", *(f"_{n}" for n in values), *(f"^{n}" for n in values), *(f"^^{c}" for c in [*keys, "_piece"]))


def _same(keys: list[str]) -> Column:
    met = F.lit(True)
    for c in keys:
        met = met & F.col(c).eqNullSafe(F.col(f"`^^{c}`"))
    return met


def placed(bars: DataFrame, order: str = "ts") -> DataFrame:
    """bars with idx, their place within the symbol from 0, by days."""
    return running(bars, ["symbol"], F.col(order).cast("date"), [order], {"idx": ("count", F.lit(1))}).withColumn("idx", F.col("idx") - 1)


def ranged(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows dealt to ranges by order and written, with _range, which never falls along it. A lost executor can't draw the ranges anew."""
    return written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """Adds each row's place (from 1) within its key, by order."""
    return running(ranged(rows, [*keys, *order], "numbered"), keys, F.col("_range"), order, {name: ("count", F.lit(1))}).drop("_range")


def percentiles(rows: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """keys and q, the exact percentiles of a column, interpolated between neighbours as SQL's percentile_cont; no row for a key without values.

    Distributed selection: equal values are one row with a count, ranges of values are counted, and only the ranges that hold a wanted rank are ordered
    further.
    """
    values = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = ranged(values, [*keys, "v"], "percentiles")
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"total": F.sum("n").over(over), "before": F.coalesce(F.sum("n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    wanted = sizes.withColumn("w", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for i, p in enumerate(shares))))).select(*keys, "_range", "n", "before", "w.*")
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).drop("n")
    held = dealt.join(wanted.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("upto", upto)
    found = held.join(wanted, [*keys, "_range"]).where((F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("rank") < F.col("before") + F.col("upto")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    at = F.first("at")
    each = found.groupBy(*keys, "i").agg(low.alias("low"), high.alias("high"), F.floor(at).alias("f"), F.ceil(at).alias("c"), at.alias("at"))
    each = each.withColumn("x", F.when(F.col("f") == F.col("c"), F.col("low")).otherwise((F.col("c") - F.col("at")) * F.col("low") + (F.col("at") - F.col("f")) * F.col("high")))
    made = each.groupBy(*keys) if keys else each.groupBy()
    return made.agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("q")).select(*keys, F.transform("q", lambda s: s.x).alias("q"))
