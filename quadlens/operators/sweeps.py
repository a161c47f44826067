"""Sweeps over thresholds by one sorted pass: how many values lie within each of any number of thresholds, and the first
threshold at which a signal leaves the band of its null controls.

Values and thresholds are ranked together, range by range (see splits.running_sums); a threshold's count is the running count at
its place. Nothing is multiplied by the number of thresholds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.operators.graph import cut
from quadlens.operators.splits import running_sums


def within_each(rows: DataFrame, value: str, thresholds: DataFrame, threshold: str, groups: dict[str, str]) -> DataFrame:
    """threshold and, for each name of groups (a condition on rows), how many of these rows have a value of at most the threshold.

    thresholds: one column of distinct values. Null values lie within none.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_at")).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in groups.items()])
    asked = thresholds.select(F.col(threshold).cast("double").alias("_at"), *[F.lit(0).cast("long").alias(k) for k in groups]).where("_at IS NOT NULL").distinct()
    # equal values come before the threshold, which itself counts nothing
    both = counts.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1))).withColumnsRenamed({k: f"_g_{k}" for k in groups})
    at = running_sums(both, {k: F.col(f"_g_{k}") for k in groups}, "_at", "_kind").where("_kind = 1")
    return at.select(F.col("_at").alias(threshold), *groups)


def curves(counts: DataFrame, threshold: str, names: list[str]) -> DataFrame:
    """counts as shares of each group's rows within the largest threshold."""
    top = counts.agg(*[F.max(k).alias(f"_n_{k}") for k in names])
    return counts.crossJoin(F.broadcast(top)).select(threshold, *[F.try_divide(F.col(k), F.col(f"_n_{k}")).alias(k) for k in names])  # one row


def floor_of(counts: DataFrame, threshold: str, nulls: tuple[str, str], signal: str) -> DataFrame:
    """One row: band, the largest gap between the curves of two null controls; floor, the least threshold at which the signal
    differs from both by more than the band (null if none does); at_floor, by how much."""
    c = cut(curves(counts, threshold, [*nulls, signal]))
    band = c.agg(F.max(F.abs(F.col(nulls[0]) - F.col(nulls[1]))).alias("band"))
    gap = F.least(*[F.abs(F.col(signal) - F.col(n)) for n in nulls])
    beyond = c.crossJoin(F.broadcast(band)).withColumn("_gap", gap).where(F.col("_gap") > F.col("band"))  # one row
    first = beyond.agg(F.min(threshold).alias("floor"), F.min_by("_gap", threshold).alias("at_floor"))
    n = c.agg(F.count("*").alias("n_thresholds"))
    return n.crossJoin(band).crossJoin(first)  # one row each
