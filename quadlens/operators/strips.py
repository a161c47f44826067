"""Agreement of annotated point strips with a family: wrap index along each strip, referenced to its own median."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadlens.functions.stats import pct
from quadlens.functions.vectors import TURN
from quadlens.operators import mesh
from quadlens.operators.intrinsic import axis_at
from quadlens.operators.nearest import nearest_faces
from quadlens.operators.scans import running_total

STRIP = ["source", "collection"]
DECISION = 0.5


def turn_fix(step: Column) -> Column:
    """The whole turns that bring a step within half a turn; none without a step."""
    small = F.pmod(step + math.pi, F.lit(TURN)) - math.pi
    small = F.when((small == -math.pi) & (step > 0), math.pi).otherwise(small)
    return F.coalesce(F.when(F.abs(step) < math.pi, 0.0).otherwise(small - step), F.lit(0.0))


def with_turns(points: DataFrame, by: list[str], order: str, theta: str = "theta", ranges: int | None = None) -> DataFrame:
    """points with `turns`, the azimuth travelled along each strip; a strip may be longer than a task."""
    step = F.col(theta) - F.col("_theta_before")
    rows = running_total(points, by, [order], {"_theta_before": F.col(theta)}, turn_fix(step), "_total", ranges)
    return rows.withColumn("turns", (F.col(theta) + F.col("_total")) / TURN).drop("_total")


def normalised(points: DataFrame) -> DataFrame:
    """points with their kind and wind_a made whole: all missing counts as zero everywhere, else missing ones go."""
    n = F.count("wind_a").over(Window.partitionBy(*STRIP))
    points = points.withColumn("_n", n).withColumn("kind", F.when(F.col("_n") > 0, "relative").otherwise("same-winding"))
    points = points.withColumn("wind_a", F.when(F.col("_n") == 0, 0.0).otherwise(F.col("wind_a")))
    return points.where("wind_a IS NOT NULL").drop("_n")


def wrap_points(points: DataFrame, family: DataFrame, umbilicus: DataFrame, z_range: tuple[float, float] | None = None, find=nearest_faces) -> DataFrame:
    """One row per strip point inside the window: distance, u, theta, turns and wrap index."""
    points = normalised(points)
    points = points.where(F.col("z").between(*z_range)) if z_range else points
    keys = [*STRIP, "point"]
    near = find(points.select(*keys, *[F.col(a).alias(f"p{a}") for a in "zyx"]), mesh.faces(family), keys, ["u"]).select(*keys, "dist", "u")
    rows = axis_at(points.join(near, keys), umbilicus)
    rows = rows.withColumn("theta", F.atan2(F.col("y") - F.col("ay"), F.col("x") - F.col("ax")))
    rows = with_turns(rows, STRIP, "point")
    return rows.withColumn("wrap", F.col("u") - F.col("turns") - F.col("wind_a")).drop("ay", "ax")


def judged(rows: DataFrame, tau: float = 6.0, by: list[str] = STRIP) -> DataFrame:
    """rows with decidable, offset (from the median wrap index of the decidable ones) and agree."""
    rows = rows.withColumn("decidable", F.col("dist") <= tau)
    mid = rows.where("decidable").groupBy(*by).agg(F.median("wrap").alias("_mid"))
    rows = rows.join(mid, by, "left").withColumn("offset", F.col("wrap") - F.col("_mid")).drop("_mid")
    return rows.withColumn("agree", F.col("decidable") & (F.abs("offset") < DECISION))


def verdicts(rows: DataFrame, points: DataFrame, by: list[str] = STRIP) -> DataFrame:
    """One row per strip, those without a point in the window included."""
    told = rows.groupBy(*by).agg(
        F.count("*").alias("n_in_window"), F.count_if("decidable").alias("n_within_tau"), F.count_if(F.coalesce("agree", F.lit(False))).alias("n_agree"),
        pct("dist", 0.5).alias("dist_p50"), F.max("dist").alias("dist_max"), F.max(F.when(F.col("agree"), F.abs("offset"))).alias("spread"),
    )
    all_strips = points.groupBy(*STRIP).agg(F.first("name").alias("name"), F.count("*").alias("n_points"), F.when(F.count("wind_a") > 0, "relative").otherwise("same-winding").alias("kind"), (F.when(F.count("wind_a") > 0, F.count("*") - F.count("wind_a")).otherwise(0)).alias("n_dropped"))
    zero = {c: 0 for c in ("n_in_window", "n_within_tau", "n_agree")}
    return all_strips.join(told, STRIP, "left").fillna(zero)


def offenders(rows: DataFrame) -> DataFrame:
    """Decidable points that disagree."""
    bad = rows.where(F.col("decidable") & ~F.col("agree"))
    return bad.select(*STRIP, "point", "z", "y", "x", F.degrees("theta").alias("theta_deg"), "offset", F.rint("offset").cast("int").alias("offset_rounded"), "dist")


def pooled(v: DataFrame) -> DataFrame:
    """Counts pooled over points, over all strips and for each kind ('all' first)."""
    some, two, perfect = F.col("n_within_tau") > 0, F.col("n_within_tau") >= 2, F.col("n_agree") == F.col("n_within_tau")
    out = v.rollup("kind").agg(
        F.count("*").alias("n_collections"), F.count_if(some).alias("n_decidable"), F.count_if(some & perfect).alias("n_perfect"), F.count_if(two).alias("n_informative"), F.count_if(two & perfect).alias("n_informative_perfect"),
        F.sum("n_points").alias("n_points"), F.sum("n_in_window").alias("n_in_window"), F.sum("n_within_tau").alias("n_within_tau"), F.sum("n_agree").alias("n_agree"), F.max("spread").alias("spread_max"),
    )
    return out.withColumn("kind", F.coalesce("kind", F.lit("all"))).withColumn("agreement", F.try_divide("n_agree", "n_within_tau"))


def tau_sweep(rows: DataFrame, taus=(2.0, 4.0, 6.0, 10.0, 20.0)) -> DataFrame:
    """tau, n_within_tau, n_agree: distances are found once, the reference median anew for each tau."""
    each = rows.withColumn("tau", F.explode(F.array(*map(F.lit, taus))))
    by = [*STRIP, "tau"]
    each = each.withColumn("decidable", F.col("dist") <= F.col("tau"))
    mid = each.where("decidable").groupBy(*by).agg(F.median("wrap").alias("_mid"))
    each = each.join(mid, by, "left").withColumn("agree", F.col("decidable") & (F.abs(F.col("wrap") - F.col("_mid")) < DECISION))
    return each.groupBy("tau").agg(F.count_if("decidable").alias("n_within_tau"), F.count_if(F.coalesce("agree", F.lit(False))).alias("n_agree"))


def z_profile(rows: DataFrame, z_range: tuple[float, float], near: float = 20.0) -> DataFrame:
    """Where decidable and undecidable points lie in z."""
    edge = F.least(F.col("z") - z_range[0], z_range[1] - F.col("z")) <= near
    return rows.groupBy("decidable").agg(F.count("*").alias("n"), pct("z", 0.5).alias("z_p50"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count_if(edge).alias("n_near_edge"))
