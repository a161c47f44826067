"""Radial order and spacing of neighbouring windings around an axis, without any evidence."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlens.functions.stats import fraction
from quadlens.functions.vectors import polar
from quadlens.operators.graph import cut

KINDS = ("violation", "collapsed", "inflated")


def umbilicus_table(spark: SparkSession, points: list[tuple[float, float, float]]) -> DataFrame:
    """An axis as control points (z, y, x): two numbers are a straight one."""
    return spark.createDataFrame([tuple(map(float, p)) for p in points], "z double, y double, x double")


def axis_at(rows: DataFrame, umbilicus: DataFrame, z: str = "z") -> DataFrame:
    """rows with the axis (ay, ax) at their z: linear between control points, constant beyond the ends.

    The control points are few (one axis); they become intervals that are broadcast and range-joined.
    """
    w = Window.orderBy("z")
    nxt = {c: F.lead(c).over(w).alias(f"{c}1") for c in "zyx"}
    seg = umbilicus.select(*[F.col(c).alias(f"{c}0") for c in "zyx"], *[nxt[c] for c in "zyx"], F.row_number().over(w).alias("n"))
    seg = seg.select(F.when(F.col("n") == 1, F.lit(-math.inf)).otherwise(F.col("z0")).alias("_lo"), F.coalesce("z1", F.lit(math.inf)).alias("_hi"), *[f"{c}{k}" for c in "zyx" for k in (0, 1)])
    v = F.col(z).cast("double")
    t = F.when(F.col("z1").isNull() | (v <= F.col("z0")), 0.0).otherwise(F.try_divide(v - F.col("z0"), F.col("z1") - F.col("z0")))
    at = lambda c: (F.col(f"{c}0") + t * (F.coalesce(f"{c}1", f"{c}0") - F.col(f"{c}0"))).alias(f"a{c}")
    return rows.join(F.broadcast(seg), (v >= F.col("_lo")) & ((v < F.col("_hi")) | F.col("z1").isNull())).select(*rows.columns, at("y"), at("x"))


def binned_radius(family: DataFrame, umbilicus: DataFrame, z_bins: int = 10, theta_bins: int = 48, min_count: int = 3) -> DataFrame:
    """winding, zb, tb, mean_r, n of the cells with enough vertices. The axis is taken at the middle of a z bin."""
    v = cut(family.where("valid").select("winding", *[F.col(c).cast("double").alias(c) for c in "zyx"]))
    ends = v.agg(F.min("z").alias("lo"), (F.max("z") + 1e-6).alias("hi")).first()
    if ends["lo"] is None:
        raise ValueError("no valid vertex")
    lo, hi = F.lit(ends["lo"]), F.lit(ends["hi"])
    edge = lambda k: F.when(k == z_bins, hi).otherwise(lo + k * ((hi - lo) / z_bins))
    guess = F.least(F.greatest(F.floor((F.col("z") - lo) / ((hi - lo) / z_bins)), F.lit(0)), F.lit(z_bins - 1))
    v = v.withColumn("zb", guess).withColumn("zb", (F.col("zb") + (F.col("z") >= edge(F.col("zb") + 1)).cast("int") - (F.col("z") < edge(F.col("zb"))).cast("int")).cast("int"))
    v = axis_at(v.withColumn("zc", (edge(F.col("zb")) + edge(F.col("zb") + 1)) / 2), umbilicus, "zc")
    r, theta = polar(F.col("y"), F.col("x"), F.col("ay"), F.col("ax"))
    tb = F.floor((theta + math.pi) / (2 * math.pi) * theta_bins)
    tb = F.least(F.greatest(tb, F.lit(0)), F.lit(theta_bins - 1)).cast("int")
    cells = v.select("winding", "zb", tb.alias("tb"), r.alias("r")).groupBy("winding", "zb", "tb").agg(F.avg("r").alias("mean_r"), F.count("*").alias("n"))
    return cells.where(F.col("n") >= min_count)


def gaps(cells: DataFrame, family: DataFrame) -> DataFrame:
    """inner, zb, tb, gap per winding between each winding and the next one of the family in the same cell."""
    ids = family.select("winding").distinct()
    nxt = ids.select("winding", F.lead("winding").over(Window.orderBy("winding")).alias("outer"))  # as many rows as windings
    other = cells.select(F.col("winding").alias("outer"), "zb", "tb", F.col("mean_r").alias("r2"))
    g = cells.join(nxt, "winding").join(other, ["outer", "zb", "tb"])
    return g.select(F.col("winding").alias("inner"), "zb", "tb", ((F.col("r2") - F.col("mean_r")) / (F.col("outer") - F.col("winding"))).alias("gap"))


def classed(g: DataFrame, collapse: float = 0.2, inflate: float = 2.5) -> DataFrame:
    """g with the median pitch and each gap's kind (ok, violation, collapsed or inflated)."""
    g = cut(g)
    g = g.withColumn("pitch", F.lit(g.agg(F.median("gap")).first()[0]).cast("double"))
    kind = F.when(F.col("gap") <= 0, "violation").when(F.col("gap") < collapse * F.col("pitch"), "collapsed").when(F.col("gap") > inflate * F.col("pitch"), "inflated").otherwise("ok")
    return g.withColumn("kind", kind)


def worst(g: DataFrame, top: int = 20) -> DataFrame:
    """The worst cells, kinds taking turns by rank, so that a frequent kind does not hide the others."""
    bad = g.where("kind <> 'ok'").withColumn("severity", F.when(F.col("kind") == "inflated", -F.col("gap")).otherwise(F.col("gap")))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.round("severity", 9), "inner", "zb", "tb"))
    bad = bad.withColumn("rank", rank).where(F.col("rank") <= top)
    turn: Column = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).otherwise(2)
    return bad.orderBy("rank", turn).limit(top).select("kind", "rank", "inner", "zb", "tb", "gap")


def report(g: DataFrame) -> DataFrame:
    """One row of counters and fractions over the classed gaps."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    return g.agg(F.count("*").alias("n_bins"), F.first("pitch").alias("median_pitch"), *kinds, *[fraction(F.col("kind") == k).alias(f"frac_{k}") for k in KINDS[:2]])


def validity(family: DataFrame) -> DataFrame:
    return family.groupBy("winding").agg(fraction(F.col("valid")).alias("validity"))
