"""Scores of evidence patches against a family: per point, per patch, pooled, and on unseen evidence only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlens.functions.stats import fraction, modes, pct, quantile_block, weighted
from quadlens.functions.vectors import angle_deg, triple
from quadlens.operators import mesh, sheets
from quadlens.operators.graph import cut
from quadlens.operators.nearest import nearest_faces
from quadlens.operators.splits import numbered

TAU, UNSEEN_DIST, MIN_UNSEEN = 6.0, 2.0, 8
LEAKAGE = (0.5, 1.0, 2.0, 6.0)
PATCH = ["patch"]


def patch_points(patches: DataFrame, z_range: tuple[float, float] | None = None) -> DataFrame:
    """patch, row, col, pz, py, px, normal and quad label of each quad center inside the z window."""
    carry = ["label"] if "label" in patches.columns else []
    q = mesh.quad_normals(mesh.centers(mesh.quads(patches, PATCH, carry)))
    label = (F.col("label00") + F.col("label01") + F.col("label10") + F.col("label11")) / 4 if carry else F.lit(None).cast("double")
    q = q.select("patch", "row", "col", *[F.col(f"c{a}").alias(f"p{a}") for a in "zyx"], "nz", "ny", "nx", label.alias("quad_label"))
    return q.where(F.col("pz").between(*z_range)) if z_range else q


def point_scores(patches: DataFrame, family: DataFrame, inputs: DataFrame | None = None, z_range: tuple[float, float] | None = None, find=nearest_faces) -> DataFrame:
    """One row per quad center: distance, winding and u of the nearest face, normal angle, and distance to the inputs."""
    points, keys = patch_points(patches, z_range), ["patch", "row", "col"]
    f = mesh.face_normals(mesh.faces(family))
    carry = ["pz", "py", "px", "nz", "ny", "nx", "quad_label"]
    out = find(points, f, keys, ["u", "mz", "my", "mx"], carry).withColumn("angle", angle_deg(triple("n"), triple("m")))
    out = out.select(*keys, *[F.col(f"p{a}").alias(a) for a in "zyx"], "quad_label", "dist", F.col("face_winding").alias("winding"), "u", "angle")
    if inputs is None:
        return out.withColumn("input_dist", F.lit(None).cast("double"))
    own = ["z", "y", "x", "quad_label", "dist", "winding", "u", "angle"]
    asked = out.withColumns({f"p{a}": F.col(a) for a in "zyx"}).withColumnRenamed("dist", "family_dist")
    found = find(asked, mesh.faces(inputs), keys, [], [c if c != "dist" else "family_dist" for c in own])
    return found.withColumnsRenamed({"dist": "input_dist"}).withColumnRenamed("family_dist", "dist").select(*keys, *own, "input_dist")


def as_surfaces(patches: DataFrame) -> DataFrame:
    """Patches numbered by name as if they were windings, so that their faces can be made."""
    ids = numbered(patches.select("patch").distinct(), "patch").select("patch", (F.col("n") + 1).cast("int").alias("winding"))
    return patches.join(ids, "patch").select("winding", "row", "col", "z", "y", "x", "valid")


def winding_agreement(points: DataFrame) -> DataFrame:
    """patch, agreement: how often relative windings of labels and assignments agree, once both are centered on their modes."""
    p = points.where("quad_label IS NOT NULL")
    mid = p.groupBy("patch").agg(F.median("quad_label").alias("mid"), F.count("*").alias("k")).where("k >= 2")
    p = p.join(mid, "patch").withColumn("told", F.rint(F.col("quad_label") - F.col("mid")))
    a = modes(p, PATCH, "told").select("patch", F.col("mode").alias("told_mode"))
    b = modes(p, PATCH, "winding").select("patch", F.col("mode").alias("own_mode"))
    p = p.join(a, "patch").join(b, "patch")
    return p.groupBy("patch").agg(fraction((F.col("told") - F.col("told_mode")) == (F.col("winding") - F.col("own_mode"))).alias("agreement"))


def scored(patches: DataFrame, family: DataFrame, inputs: DataFrame | None = None, z_range: tuple[float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(point scores, skipped): patches without a point to score, inside the z window, are skipped and told by name."""
    points = cut(point_scores(patches, family, None if inputs is None else as_surfaces(inputs), z_range))
    return points, patches.select("patch").distinct().join(points.select("patch").distinct(), "patch", "left_anti")


def patch_scores(points: DataFrame, tau: float = TAU, unseen: float = UNSEEN_DIST) -> DataFrame:
    """One row per patch, from point_scores with sheet labels (sheets.with_sheets); the unseen_ numbers are those of its
    points farther than `unseen` from all inputs, null if it has none."""
    far = F.col("input_dist") > unseen
    of = lambda c: F.when(far, F.col(c))
    base = points.groupBy("patch").agg(
        F.count("*").alias("n_points"), *quantile_block("dist", "dist"), fraction(F.col("dist") <= tau).alias("frac_within_tau"),
        pct("angle", 0.5).alias("angle_p50"), pct("angle", 0.9).alias("angle_p90"), F.count_if(far).alias("n_unseen"),
        *[pct(of("dist"), q).alias(f"unseen_dist_{n}") for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))], F.max(of("dist")).alias("unseen_dist_max"),
        F.avg(F.when(far, (F.col("dist") <= tau).cast("double"))).alias("unseen_frac_within_tau"), pct(of("angle"), 0.9).alias("unseen_angle_p90"),
    )
    share = sheets.largest_share(points.where(far), PATCH).withColumnRenamed("share", "unseen_sheet_consistency")
    base = base.join(share, "patch", "left")
    modal = modes(points, PATCH, "winding").select("patch", F.col("mode").alias("modal_winding"), F.col("share").alias("single_winding"))
    sheet = sheets.largest_share(points, PATCH).withColumnRenamed("share", "sheet_consistency")
    return base.join(modal, "patch").join(sheet, "patch").join(winding_agreement(points), "patch", "left")


def aggregate(points: DataFrame, scores: DataFrame, tau: float = TAU) -> DataFrame:
    """One row: percentiles pooled over points, consistencies weighted by points."""
    pooled = points.agg(*quantile_block("dist", "dist"), fraction(F.col("dist") <= tau).alias("frac_within_tau"), pct("angle", 0.9).alias("angle_p90"))
    own = scores.agg(
        F.count("*").alias("n_patches"), F.sum("n_points").alias("n_points"), weighted("single_winding", "n_points").alias("mean_single_winding"), F.min("single_winding").alias("min_single_winding"),
        weighted("sheet_consistency", "n_points").alias("mean_sheet"), F.min("sheet_consistency").alias("min_sheet"), weighted("agreement", "n_points").alias("mean_agreement"),
    )
    return own.crossJoin(pooled)


def leakage_profile(points: DataFrame) -> DataFrame:
    return points.agg(*[fraction(F.col("input_dist") <= t).alias(f"within_{str(t).replace('.', '_')}") for t in LEAKAGE])


def full_aggregate(points: DataFrame, scores: DataFrame, skipped: DataFrame, tau: float = TAU, unseen: float = UNSEEN_DIST, inputs: DataFrame | None = None) -> DataFrame:
    """aggregate with the number of skipped patches and, where inputs are given, evidence_leakage and unseen as structs."""
    one = aggregate(points, scores, tau).crossJoin(skipped.agg(F.count("*").alias("n_patches_skipped")))
    if inputs is None:
        return one
    leak = leakage_profile(points).crossJoin(inputs.agg(F.count_distinct("patch").alias("n_input_patches")))
    far = unseen_aggregate(points, tau, MIN_UNSEEN, unseen)
    return one.crossJoin(leak.select(F.struct("*").alias("evidence_leakage"))).crossJoin(far.select(F.struct("*").alias("unseen")))  # one row each


def unseen_aggregate(points: DataFrame, tau: float = TAU, least: int = MIN_UNSEEN, unseen: float = UNSEEN_DIST) -> DataFrame:
    """One row over the points far from all inputs, of patches that have enough of them; sheets keep their full-patch labels."""
    far = points.where(F.col("input_dist") > unseen)
    enough = far.groupBy("patch").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    kept = far.join(enough, "patch")
    share = sheets.largest_share(kept, PATCH).join(enough, "patch")
    pooled = kept.agg(F.count("*").alias("n_points"), *quantile_block("dist", "dist"), fraction(F.col("dist") <= tau).alias("frac_within_tau"), pct("angle", 0.9).alias("angle_p90"))
    own = share.agg(F.count("*").alias("n_patches"), weighted("share", "k").alias("mean_sheet"), F.min("share").alias("min_sheet"))
    total = points.agg(F.count_distinct("patch").alias("n_all"))
    return own.crossJoin(pooled).crossJoin(total).withColumn("n_excluded", F.col("n_all") - F.col("n_patches")).drop("n_all")


def drift_medians(points: DataFrame, max_jump: float = sheets.MAX_JUMP) -> DataFrame:
    """patch, drift_row, drift_col: the median change of u over smooth neighbours, 0 without any."""
    e = mesh.grid_edges(points, PATCH, ["u"]).withColumn("du", F.col("u2") - F.col("u")).where(F.abs("du") <= max_jump)
    d = e.groupBy("patch").agg(*[F.coalesce(F.median(F.when(F.col("way") == w, F.col("du"))), F.lit(0.0)).alias(f"drift_{w}") for w in ("row", "col")])
    return points.select("patch").distinct().join(d, "patch", "left").select("patch", *[F.coalesce(f"drift_{w}", F.lit(0.0)).alias(f"drift_{w}") for w in ("row", "col")])
