"""Small column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held within low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, num(high)), num(low)))


def peak(x: Column, low: float, high: float, width: float) -> Column:
    """1 within low and high, falling to 0 over width on either side; a half for null."""
    off = F.greatest(low - x, x - high, F.lit(0.0))
    return F.when(x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - off / width))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null, over their weights alone; 0 without any."""
    total = weights = F.lit(0.0)
    for score, weight in parts:
        total = total + F.coalesce(score * weight, F.lit(0.0))
        weights = weights + F.when(score.isNotNull(), weight).otherwise(0.0)
    return F.when(weights > 0, F.least(total / weights, F.lit(1.0))).otherwise(0.0)


def recoded(x: Column) -> Column:
    """Truth values, as such or as the words True and False, as 1 and 0; anything else is 0."""
    return F.when(x.cast("string").isin("true", "True"), 1).otherwise(0)


def symbol_key(symbol: Column) -> Column:
    """A storage key: a leading caret becomes IDX_, otherwise dots become underscores."""
    return F.when(F.startswith(symbol, F.lit("^")), F.concat(F.lit("IDX_"), F.substr(symbol, F.lit(2)))).otherwise(F.replace(symbol, F.lit("."), F.lit("_")))


def missing(df, **typed) -> object:
    """df with typed null columns where it lacks them."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in typed.items() if c not in df.columns})
