"""Null control over overlapping patches: how far apart are two patches that show the same sheet?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadlens.functions.stats import fraction, pct
from quadlens.operators import mesh, scoring
from quadlens.operators.nearest import nearest_faces

LEAST, CLOSE = 20, 2.0


def first_partner(listed: DataFrame, known: DataFrame) -> DataFrame:
    """patch, partner: of each patch's list of partners (array column `partners`) the first that is among known (patch)."""
    each = listed.select("patch", F.posexplode("partners").alias("pos", "partner")).where("partner <> patch")
    each = each.join(known.select(F.col("patch").alias("partner")), "partner", "left_semi")
    return each.groupBy("patch").agg(F.min_by("partner", "pos").alias("partner"))


def chosen_pairs(pairs: DataFrame, most: int, seed: int = 20260731) -> DataFrame:
    """At most so many pairs, in the order of a hash of the patch and the seed, numbered from 0."""
    few = pairs.orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "patch"), 256)).limit(most)
    return few.withColumn("pair", (F.row_number().over(Window.orderBy("patch", "partner")) - 1).cast("int"))  # at most `most` rows


def overlap_distances(patches: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, row, col, dist of the points of a pair's patch whose nearest face of the partner is not at its boundary.

    All pairs are met in one join, each within its own partner's faces.
    """
    points = scoring.patch_points(patches).join(pairs, "patch")
    other = patches.withColumnRenamed("patch", "partner").join(pairs.select("partner", "pair"), "partner").withColumn("winding", F.lit(0))
    near = nearest_faces(points, mesh.faces(other, ["pair"]), ["pair", "row", "col"], within=["pair"])
    edge = mesh.boundary_quads(mesh.quads(other, ["pair"]), ["pair"])
    edge = edge.select("pair", F.col("row").alias("face_row"), F.col("col").alias("face_col"), "boundary")
    inner = near.join(edge, ["pair", "face_row", "face_col"]).where("NOT boundary")
    return inner.select("pair", "row", "col", "dist")


def overlap_report(distances: DataFrame, least: int = LEAST, close: float = CLOSE) -> DataFrame:
    """One row over pairs with enough points: how many, the median of their medians and of their 95th percentiles, and the share that is close."""
    per = distances.groupBy("pair").agg(F.count("*").alias("n"), F.median("dist").alias("p50"), pct("dist", 0.95).alias("p95")).where(F.col("n") >= least)
    return per.agg(F.count("*").alias("n_pairs"), F.median("p50").alias("median_p50"), F.median("p95").alias("median_p95"), fraction(F.col("p95") <= close).alias("share_close"))
