"""Exact quantiles of groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.operators.splits import running


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys, n and one column per quantile: exact, with linear interpolation, of each group's non-null values.

    Equal values are counted first, then distinct ones are ranked by ranges of (keys, value), so neither a large group
    nor a frequent value has to fit one task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k"))
    placed = running(counts, F.col("_k"), *keys, value)
    groups = placed.groupBy(*keys).agg(F.min("before").alias("_first"), F.sum("_k").alias("n"))
    placed = placed.join(groups, keys) if keys else placed.crossJoin(F.broadcast(groups))  # one row
    at = F.col("before") - F.col("_first")

    def value_at(rank):
        return F.max(F.when((at <= rank) & (rank < at + F.col("_k")), F.col(value).cast("double")))

    found = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("n") - 1)
        found += [value_at(F.floor(place)).alias(f"_lo_{name}"), value_at(F.ceil(place)).alias(f"_hi_{name}")]
    out = placed.groupBy(*keys, "n").agg(*found)
    place = {name: F.lit(q) * (F.col("n") - 1) for name, q in quantiles.items()}
    mixed = [(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (p - F.floor(p))).alias(k) for k, p in place.items()]
    return out.select(*keys, "n", *mixed)


def sagitta(radius, step):
    """How far a chord over an angle of `step` lies inside an arc of this radius: what flat faces add to a distance."""
    return F.col(radius) * (1 - F.cos(F.col(step) / 2)) if isinstance(radius, str) else radius * (1 - math.cos(step / 2))
