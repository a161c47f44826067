"""Aggregates used all over: fractions, interpolated percentiles, weighted means, modes with a fixed tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pct(c: str | Column, q: float) -> Column:
    """Exact percentile with linear interpolation."""
    return F.percentile(c, F.lit(q))


def weighted(value: str, weight: str) -> Column:
    """Mean of value weighted by weight over rows with a value; null without any."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(value) * w), F.sum(w))


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, share, n: the most frequent value (smallest on ties), its share and the number of values.

    Counts first, so a large group is combined map-side, then one scalar ordering per group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(value)).alias("_v"))).alias("_b")
    return counts.groupBy(*keys).agg(best, F.sum("_n").alias("n")).select(*keys, (-F.col("_b._v")).alias("mode"), (F.col("_b._n") / F.col("n")).alias("share"), "n")


def quantile_block(prefix: str, value: str) -> list[Column]:
    return [pct(value, q).alias(f"{prefix}_{name}") for name, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))] + [F.max(value).alias(f"{prefix}_max")]


def round_scaled(c: Column, digits: int) -> Column:
    """c, a double, rounded as SQL engines over doubles do: c times 10^digits goes to the nearest whole number, halves away from zero.

    F.round takes the shortest decimal form of c for its value instead, so that it rounds 16.5903775 up, which times 10^6
    is less than a half above 16590377.
    """
    scaled = F.round(c * F.lit(10.0**digits))
    return F.when(F.abs(scaled) < float("inf"), scaled / F.lit(10.0**digits)).otherwise(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its floating columns rounded, for results that are compared across engines."""
    return df.select(*[round_scaled(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
