"""First hits and all hits of conditions over long histories, by a pyramid of block extremes.

Level 0 are a symbol's bars, a node of level k + 1 sums up FAN nodes of level k: the extremes of their lows, highs and closes. A
question about the bars after a place meets its siblings on every level (those under the same parent), which tile all that
follows, in one join; the first node that may hold the answer is then descended level by level. So a question makes FAN pairs a level, and
levels grow with the logarithm of the bars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.sources.shared import written

#: Nodes under one parent, and parts that the questions of the upper levels are dealt to.
FAN, PARTS = 64, 8

#: What a bar brings along besides the extremes.
CARRIED = ("bar_ts", "close", "atr")

#: Whether a node may hold a bar in question (for bars: whether it is one), given the asked row's columns and low, high, low_close, high_close.
Test = Callable[[], Column]


class Pyramid:
    """bars: symbol, idx, ts, low, high, close, atr (null atr where there is none)."""

    def __init__(self, bars: DataFrame):
        atr = F.col("atr").cast("double") if "atr" in bars.columns else F.lit(None).cast("double")
        last = (bars.agg(F.max("idx")).first()[0] or 0) + 1
        self.levels = 0  # above the bars
        while last >= FAN ** (self.levels + 1):
            self.levels += 1
        node = F.col("idx").cast("long") + 1  # so that -1, before the first bar, has a place too
        base = bars.select("symbol", F.lit(0).alias("level"), node.alias("node"), "low", "high", F.col("close").alias("low_close"), F.col("close").alias("high_close"), F.col("ts").alias("bar_ts"), "close", atr.alias("atr"))
        self.base = self._dealt(base.withColumn("part", F.lit(0)))
        self.every = self.base
        if self.levels:
            above, made = base, None
            for k in range(1, self.levels + 1):
                above = above.groupBy("symbol", F.floor(F.col("node") / FAN).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_close").alias("low_close"), F.max("high_close").alias("high_close"))
                level = above.select("symbol", F.lit(k).alias("level"), "node", "low", "high", "low_close", "high_close")
                made = level if made is None else made.unionByName(level)
            self.upper = written(made, "pyramid")
            parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
            empty = {c: F.lit(None).cast(base.schema[c].dataType) for c in CARRIED}
            self.every = self.every.unionByName(self._dealt(self.upper.withColumns(empty).withColumn("part", parts)))

    @staticmethod
    def _dealt(nodes: DataFrame) -> DataFrame:
        """With the parent, under names that no asked row has."""
        return nodes.withColumn("parent", F.floor(F.col("node") / FAN)).withColumnsRenamed({c: f"n_{c}" for c in ("symbol", "level", "node", "parent", "part")})

    def _nodes(self, level: int) -> DataFrame:
        return self.every.where((F.col("n_level") == level) & (F.col("n_part") == 0)) if level else self.base

    def _tiled(self, asked: DataFrame, test: Test) -> DataFrame:
        """The nodes that tile what lies after `after` (and before `before`, if asked has it) and pass: asked's columns, level, node and what a bar brings."""
        bounded = "before" in asked.columns
        hashed = F.pmod(F.hash(*asked.columns), F.lit(PARTS))
        up = asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(self.levels))))
        width = F.pow(F.lit(float(FAN)), "level").cast("long")
        up = up.withColumns({"own": F.floor((F.col("after") + 1) / width), "part": F.when(F.col("level") > 0, hashed).otherwise(0)})
        parents = F.array(F.floor(F.col("own") / FAN))
        if bounded:
            up = up.withColumn("end", F.floor((F.col("before") + 1) / width))
            parents = F.when(F.col("end").isNull(), parents).otherwise(F.array_distinct(F.array(F.floor(F.col("own") / FAN), F.floor(F.col("end") / FAN))))
        up = up.withColumn("parent", F.explode(parents))
        met = (F.col("symbol") == F.col("n_symbol")) & (F.col("level") == F.col("n_level")) & (F.col("parent") == F.col("n_parent")) & (F.col("part") == F.col("n_part")) & (F.col("n_node") > F.col("own"))
        if bounded:
            met = met & (F.col("end").isNull() | (F.col("n_node") < F.col("end")))
        return up.join(self.every, met & test()).select(*asked.columns, "level", F.col("n_node").alias("node"), *CARRIED)

    def _below(self, rows: DataFrame, columns: list[str], level: int, test: Test) -> DataFrame:
        """rows (asked's columns, level, node, ...) whose nodes of this level meet their passing children: child and what it brings (c_*); null for all others."""
        children = self._nodes(level - 1).withColumnsRenamed({c: f"c_{c}" for c in CARRIED})
        met = (F.col("symbol") == F.col("n_symbol")) & (F.col("level") == F.col("n_level") + 1) & (F.col("node") == F.col("n_parent"))
        return rows.join(children, met & test(), "left").withColumnRenamed("n_node", "child")

    def hits(self, asked: DataFrame, test: Test) -> DataFrame:
        """All bars after `after` and before `before` (null: none is too late) that pass: asked's columns, at (the bar's place), bar_ts, close, atr.
        Nodes that don't pass hold none, so that only what leads to hits is descended."""
        columns = asked.columns
        rows = self._tiled(asked, test)
        for level in range(self.levels, 0, -1):
            down = self._below(rows, columns, level, test).where((F.col("level") < level) | F.col("child").isNotNull())
            here = F.col("level") == level
            rows = down.select(*columns, F.when(here, level - 1).otherwise(F.col("level")).alias("level"), F.when(here, F.col("child")).otherwise(F.col("node")).alias("node"), *(F.when(here, F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED))
        return rows.select(*columns, (F.col("node") - 1).alias("at"), *CARRIED)

    def _round(self, asked: DataFrame, test: Test) -> DataFrame:
        """asked's columns, level, node, what a bar brings: the first bar that passes (level 0), or the node where the search ended in vain."""
        columns = asked.columns
        begins = F.col("node") * F.pow(F.lit(float(FAN)), "level").cast("long")
        brought = F.struct(begins.alias("begins"), F.col("level"), F.col("node"), *(F.col(c) for c in CARRIED))
        rows = self._tiled(asked, test).groupBy(*columns).agg(F.min(brought).alias("x")).select(*columns, "x.level", "x.node", *(f"x.{c}" for c in CARRIED))
        for level in range(self.levels, 0, -1):
            down = self._below(rows, columns, level, test).groupBy(*columns, "level", "node", *CARRIED).agg(F.min(F.when(F.col("child").isNotNull(), F.struct("child", *(F.col(f"c_{c}").alias(c) for c in CARRIED)))).alias("x"))
            here = (F.col("level") == level) & F.col("x").isNotNull()
            rows = down.select(*columns, F.when(here, level - 1).otherwise(F.col("level")).alias("level"), F.when(here, F.col("x.child")).otherwise(F.col("node")).alias("node"), *(F.when(here, F.col(f"x.{c}")).otherwise(F.col(c)).alias(c) for c in CARRIED))
        return rows

    def first(self, asked: DataFrame, test: Test, exact: bool = True) -> DataFrame:
        """The first bar after `after` that passes: asked's columns, at, bar_ts, close, atr; no row without one.

        exact: a node that passes surely holds a bar that does, as for a bound of one extreme. Otherwise (prices can jump over a range between two bars) a
        search that ends in vain goes on behind its node, in as many rounds as the unluckiest question needs.
        """
        columns = asked.columns
        rows = self._round(asked, test)
        if exact:
            return rows.select(*columns, (F.col("node") - 1).alias("at"), *CARRIED)
        width = F.pow(F.lit(float(FAN)), "level").cast("long")
        original = asked.withColumn("from", F.col("after"))
        found, pending = None, original
        while True:
            step = written(self._round(pending, test), "round")
            hit = step.where("level = 0")
            found = hit if found is None else found.unionByName(hit)
            pending = step.where("level > 0").withColumn("after", (F.col("node") + 1) * width - 2).select(original.columns)
            if pending.isEmpty():
                break
        return found.withColumn("after", F.col("from")).select(*columns, (F.col("node") - 1).alias("at"), *CARRIED)
