"""Queries over surfaces, patches and strips woven from the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadlens.functions.stats import rounded
from quadlens.functions.vectors import triple
from quadlens.operators import compare, intrinsic, mesh, overlap, scoring, sheets, strips
from quadlens.operators.graph import cut
from quadlens.operators.nearest import nearest_faces
from quadlens.operators.ranks import exact_quantiles
from quadlens.plans import sql as S
from quadlens.sources import synthetic, woven

AXIS = [(0.0, 0.0, 0.0)]
BENT_AXIS = [(0.0, -0.5, 0.25), (30.0, 0.5, 0.0), (60.0, 0.0, -0.25)]
TABLE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fam(spark, sf_dir, clean=True):
    """The family woven from orders, with a sheet swap and a collapsed gap unless clean."""
    v = woven.family(_table(spark, sf_dir, "orders"))
    return v if clean else synthetic.collapse_gap(synthetic.swap_band(v, *synthetic.DEMO_SWAP), *synthetic.DEMO_COLLAPSE)


def _patches(spark, sf_dir):
    return woven.patches(_table(spark, sf_dir, "customer"))


def _vertices(df):
    return rounded(df.select("winding", "row", "col", "z", "y", "x", "valid"), 3)


_V = "SELECT winding, r AS row, c AS col, " + S.rnd("z", "y", "x", digits=3) + ", valid FROM {}"


@query(S.with_(S.family("fam"), last=_V.format("fam")))
def gen_family(spark, sf_dir):
    return _vertices(_fam(spark, sf_dir))


@query(S.with_(S.patches("pat"), last="SELECT patch, r AS row, c AS col, " + S.rnd("z", "y", "x", digits=3) + ", label FROM pat"))
def gen_patches(spark, sf_dir):
    return rounded(_patches(spark, sf_dir).select("patch", "row", "col", "z", "y", "x", "label"), 3)


@query(S.with_(S.family("fam"), S.swapped("s", "fam", 13, 14, 1.0, 2.2), last=_V.format("s")))
def swap_band(spark, sf_dir):
    return _vertices(synthetic.swap_band(_fam(spark, sf_dir), *synthetic.DEMO_SWAP))


@query(S.with_(S.family("fam"), S.collapsed("s", "fam", 16, 4.0, 5.0, 0.9), last=_V.format("s")))
def collapse_gap(spark, sf_dir):
    return _vertices(synthetic.collapse_gap(_fam(spark, sf_dir), *synthetic.DEMO_COLLAPSE))


@query(S.with_(S.family("fam"), S.radially("s", "fam", "2e0 * sin(t)"), last=_V.format("s")))
def radial_drift(spark, sf_dir):
    return _vertices(synthetic.radial_drift(_fam(spark, sf_dir), 2.0))


@query(S.with_(S.family("fam"), S.radially("s", "fam", "CASE WHEN z >= 20 AND z < 44 AND winding IN (12, 13) THEN 5e0 ELSE 0e0 END"), last=_V.format("s")))
def displace(spark, sf_dir):
    return _vertices(synthetic.displace(_fam(spark, sf_dir), 5.0, (20.0, 44.0), [12, 13]))


@query(S.with_(S.family("fam"), S.radially("s", "fam", "10e0 * least(greatest((CAST(z AS DOUBLE) - 16e0) / 40e0, 0e0), 1e0)"), last=_V.format("s")))
def pitch_ramp(spark, sf_dir):
    return _vertices(synthetic.pitch_ramp(_fam(spark, sf_dir), 10.0, 16.0, 40.0))


@query(S.with_(S.family("fam"), S.holes("s", "fam", 5, 4, 20, 90), last=_V.format("s")))
def punch_holes(spark, sf_dir):
    return _vertices(synthetic.punch_holes(_fam(spark, sf_dir), 5, 4, 20, 90))


_HOLED = [S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), S.quads("q", "hol", "winding")]


def _holed(spark, sf_dir):
    return synthetic.punch_holes(_fam(spark, sf_dir), 5, 4, 20, 90)


@query(S.with_(*_HOLED, last="SELECT winding, CAST(count(*) AS BIGINT) AS n_quads, min(r) AS min_row, max(c) AS max_col FROM q GROUP BY winding"))
def valid_quads(spark, sf_dir):
    return mesh.quads(_holed(spark, sf_dir), ["winding"]).groupBy("winding").agg(F.count("*").alias("n_quads"), F.min("row").alias("min_row"), F.max("col").alias("max_col"))


@query(S.with_(*_HOLED, S.centers("p", "q"), last="SELECT winding, r AS row, c AS col, round(pz, 3) AS cz, round(py, 3) AS cy, round(px, 3) AS cx FROM p"))
def quad_centers(spark, sf_dir):
    return rounded(mesh.centers(mesh.quads(_holed(spark, sf_dir), ["winding"])).select("winding", "row", "col", "cz", "cy", "cx"), 3)


@query(S.with_(*_HOLED, S.quad_normals("p", "q"), last="SELECT winding, r AS row, c AS col, " + S.rnd("nz", "ny", "nx", digits=4) + " FROM p"))
def quad_normals(spark, sf_dir):
    return rounded(mesh.quad_normals(mesh.quads(_holed(spark, sf_dir), ["winding"])).select("winding", "row", "col", "nz", "ny", "nx"), 4)


@query(S.with_(S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), *S.faces("f", "hol"), last="SELECT winding, r AS row, c AS col, block, " + S.rnd("u", "gz", "gy", "gx", "radius", "mz", "my", "mx", digits=4) + " FROM f"))
def triangulate(spark, sf_dir):
    f = mesh.face_normals(mesh.faces(_holed(spark, sf_dir)))
    return rounded(f.select("winding", "row", "col", "block", "u", "gz", "gy", "gx", "radius", "mz", "my", "mx"), 4)


@query(S.with_(*_HOLED, last="""SELECT a.winding, a.r AS row, a.c AS col, (SELECT count(*) FROM q b WHERE b.winding = a.winding AND abs(a.r - b.r) + abs(a.c - b.c) = 1) < 4 AS boundary FROM q a"""))
def boundary_faces(spark, sf_dir):
    return mesh.boundary_quads(mesh.quads(_holed(spark, sf_dir), ["winding"]), ["winding"])


@query(S.with_(*S.demo("fam"), *S.faces("f", "fam"), last="""SELECT CAST(count(*) AS BIGINT) AS n_faces, CAST(count(*) FILTER (az = bz AND ay = by_ AND ax = bx) AS BIGINT) AS n_first_equal,
 CAST(count(*) FILTER (((az = cz AND ay = cy AND ax = cx) OR (bz = cz AND by_ = cy AND bx = cx)) AND NOT (az = bz AND ay = by_ AND ax = bx)) AS BIGINT) AS n_other_equal,
 CAST(count(*) FILTER (kz = 0 AND ky = 0 AND kx = 0 AND NOT (az = bz AND ay = by_ AND ax = bx) AND NOT ((az = cz AND ay = cy AND ax = cx) OR (bz = cz AND by_ = cy AND bx = cx))) AS BIGINT) AS n_collinear
 FROM (SELECT *, "by" AS by_ FROM f)"""))
def degenerate_faces(spark, sf_dir):
    return mesh.degenerate_faces(mesh.faces(_fam(spark, sf_dir, False)))


@query(S.with_(S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), last="SELECT winding, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END), 6) AS validity FROM hol GROUP BY winding"))
def validity_per_winding(spark, sf_dir):
    return rounded(intrinsic.validity(_holed(spark, sf_dir)))


@query(S.with_(S.family("fam"), last="""SELECT round(median(s), 6) AS spacing FROM (SELECT winding, median(step) AS s FROM (SELECT winding, z - lag(z) OVER (PARTITION BY winding ORDER BY r) AS step FROM (SELECT winding, r, avg(z) AS z FROM fam WHERE valid GROUP BY ALL)) WHERE step IS NOT NULL GROUP BY winding)"""))
def row_spacing(spark, sf_dir):
    return rounded(mesh.row_spacing(_fam(spark, sf_dir), ["winding"]))


_WIDE = ["wide AS (SELECT CAST(p_partkey // 13 AS INTEGER) AS r, CAST(p_partkey % 13 AS INTEGER) AS c FROM part)", "blocks AS (SELECT * FROM (VALUES (10, 0, 4), (11, 4, 7), (12, 7, 13)) t(w, j0, j1))"]
BLOCKS = [(10, 0, 4), (11, 4, 7), (12, 7, 13)]


def _wide(spark, sf_dir):
    """One surface of 13 columns, a vertex a part."""
    k = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").select(F.floor(k / 13).cast("int").alias("row"), (k % 13).cast("int").alias("col"), F.col("p_retailprice").cast("float").alias("x"))
    return part.select(F.lit("all").alias("surface"), F.lit(10).alias("winding"), "row", "col", (F.col("row") * 4).cast("float").alias("z"), (F.col("col") * 4).cast("float").alias("y"), "x", F.lit(True).alias("valid"))


@query(S.with_(*_WIDE, last="SELECT w AS winding, r AS row, c - j0 AS col FROM wide JOIN blocks ON c BETWEEN j0 AND j1"))
def split_combined(spark, sf_dir):
    return mesh.split_combined(_wide(spark, sf_dir), BLOCKS).select("winding", "row", "col")


# Intrinsic checks


def _cells(spark, sf_dir, clean=False, axis=AXIS):
    family = _fam(spark, sf_dir, clean)
    return intrinsic.binned_radius(family, intrinsic.umbilicus_table(spark, axis)), family


@query(S.with_(S.axis(BENT_AXIS), "zs AS (SELECT o_orderkey, o_totalprice / 4000 - 5 AS z FROM orders)", S.axis_at("r", "zs", "z"), last="SELECT o_orderkey, " + S.rnd("z", "ay", "ax") + " FROM r"))
def umbilicus_interp(spark, sf_dir):
    z = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 4000 - 5).alias("z"))
    return rounded(intrinsic.axis_at(z, intrinsic.umbilicus_table(spark, BENT_AXIS)))


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", BENT_AXIS), last="SELECT winding, zb, tb, round(mean_r, 5) AS mean_r, n FROM cells"))
def polar_bins(spark, sf_dir):
    return rounded(_cells(spark, sf_dir, axis=BENT_AXIS)[0], 5)


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", AXIS), last='SELECT inner_w AS "inner", zb, tb, round(gap, 5) AS gap FROM g'))
def adjacent_gaps(spark, sf_dir):
    return rounded(intrinsic.gaps(*_cells(spark, sf_dir)), 5)


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", AXIS), last='SELECT kind, inner_w AS "inner", CAST(count(*) AS BIGINT) AS n FROM cls GROUP BY ALL'))
def gap_classes(spark, sf_dir):
    return intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir))).groupBy("kind", "inner").agg(F.count("*").alias("n"))


_REPORT = "SELECT CAST(count(*) AS BIGINT) AS n_bins, round(any_value(pitch), 6) AS median_pitch, " + ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in intrinsic.KINDS) + ", " + ", ".join(f"round(avg(CASE WHEN kind = '{k}' THEN 1.0 ELSE 0.0 END), 6) AS frac_{k}" for k in intrinsic.KINDS[:2]) + " FROM cls"


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", AXIS), last=_REPORT))
def intrinsic_report(spark, sf_dir):
    return rounded(intrinsic.report(intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir)))))


@query(S.with_(*S.demo("fam", True), *S.gap_cells("fam", AXIS), last=_REPORT))
def intrinsic_report_clean(spark, sf_dir):
    return rounded(intrinsic.report(intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir, True)))))


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", AXIS), "bad AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(CASE WHEN kind = 'inflated' THEN -gap ELSE gap END, 9), inner_w, zb, tb) AS k, CASE kind WHEN 'violation' THEN 0 WHEN 'collapsed' THEN 1 ELSE 2 END AS o FROM cls WHERE kind <> 'ok')",
               last='SELECT kind, CAST(k AS INTEGER) AS rank, inner_w AS "inner", zb, tb, round(gap, 5) AS gap FROM bad ORDER BY k, o LIMIT 20'))
def worst_offenders(spark, sf_dir):
    return rounded(intrinsic.worst(intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir)))), 5)


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", AXIS), *S.demo("famc", True), *S.gap_cells("famc", AXIS, "c_"), "a AS (SELECT inner_w, zb, tb FROM cls WHERE kind = 'violation')",
               "b AS (SELECT inner_w, zb, tb FROM c_cls WHERE kind = 'violation' UNION SELECT inner_w, zb, tb FROM a WHERE inner_w = 12 UNION SELECT 11, 0, tb FROM c_cls WHERE zb = 0 AND inner_w = 11)",
               last="""SELECT 'new' AS what, inner_w AS "inner", zb, tb FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'gone', inner_w, zb, tb FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def violated_bins_diff(spark, sf_dir):
    """Bins violated in the defective family and not in a reference, and the other way round (the reference: the clean
    family, all of winding 12, and the lowest bins of winding 11)."""
    bad = intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir))).where("kind = 'violation'").select("inner", "zb", "tb")
    clean = intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir, True)))
    before = clean.where("kind = 'violation'").select("inner", "zb", "tb").unionByName(bad.where("inner = 12")).unionByName(clean.where("zb = 0 AND inner = 11").select("inner", "zb", "tb"))
    return compare.set_changes(bad, before.distinct()).select("what", "inner", "zb", "tb")


_PLANTS = {
    "clean": lambda v: v, "swap": lambda v: synthetic.swap_band(v, *synthetic.DEMO_SWAP), "collapse": lambda v: synthetic.collapse_gap(v, *synthetic.DEMO_COLLAPSE),
    "drift": lambda v: synthetic.radial_drift(v, 2.0), "displaced": lambda v: synthetic.displace(v, 8.5, (20.0, 44.0), [12, 13]), "ramp": lambda v: synthetic.pitch_ramp(v, 10.0, 16.0, 40.0), "holes": lambda v: synthetic.punch_holes(v, 5, 4, 20, 90),
}
_PLANT_SQL = {
    "clean": lambda n, s: f"{n} AS (SELECT * FROM {s})", "swap": lambda n, s: S.swapped(n, s, 13, 14, 1.0, 2.2), "collapse": lambda n, s: S.collapsed(n, s, 16, 4.0, 5.0, 0.9), "drift": lambda n, s: S.radially(n, s, "2e0 * sin(t)"),
    "displaced": lambda n, s: S.radially(n, s, "CASE WHEN z >= 20 AND z < 44 AND winding IN (12, 13) THEN 85e-1 ELSE 0e0 END"), "ramp": lambda n, s: S.radially(n, s, "10e0 * least(greatest((CAST(z AS DOUBLE) - 16e0) / 40e0, 0e0), 1e0)"), "holes": lambda n, s: S.holes(n, s, 5, 4, 20, 90),
}


@query(S.with_(S.family("fam"), *[x for k in _PLANTS for x in (_PLANT_SQL[k](f"v_{k}", "fam"), *S.gap_cells(f"v_{k}", AXIS, f"{k}_"))],
               last=" UNION ALL ".join(f"SELECT '{k}' AS scenario, CAST(count(*) AS BIGINT) AS n_bins, round(any_value(pitch), 4) AS median_pitch, " + ", ".join(f"CAST(count(*) FILTER (kind = '{x}') AS BIGINT) AS n_{x}" for x in intrinsic.KINDS) + f", CAST(count(*) FILTER (kind <> 'ok' AND inner_w BETWEEN 11 AND 16) AS BIGINT) AS n_located FROM {k}_cls" for k in _PLANTS)))
def defect_matrix(spark, sf_dir):
    """Seven planted scenarios: what the intrinsic checks see of each, and how much of it where it was planted (Q11)."""
    rows = None
    for k, plant in _PLANTS.items():
        family = plant(_fam(spark, sf_dir))
        bins = intrinsic.classed(intrinsic.gaps(intrinsic.binned_radius(family, intrinsic.umbilicus_table(spark, AXIS)), family))
        located = F.count_if((F.col("kind") != "ok") & F.col("inner").between(11, 16)).alias("n_located")
        one = bins.agg(F.lit(k).alias("scenario"), F.count("*").alias("n_bins"), F.round(F.first("pitch"), 4).alias("median_pitch"), *[F.count_if(F.col("kind") == x).alias(f"n_{x}") for x in intrinsic.KINDS], located)
        rows = one if rows is None else rows.unionByName(one)
    return rows


_UNIT = "((CAST(concat('0x', substr(md5(concat('3|', winding, '|', r, '|', c, '|{}|{}')), 1, 8)) AS BIGINT) + 5e-1) / 4294967296e0)"


@query(S.with_(S.family("fam"), last="SELECT winding, r AS row, c AS col, " + ", ".join(f"round(CAST(CAST(CAST({a} AS DOUBLE) + 5e-1 * (sqrt(-2 * ln({_UNIT.format(a, 'r')})) * cos({S.T} * {_UNIT.format(a, 't')})) AS FLOAT) AS DOUBLE), 2) AS {a}" for a in "zyx") + " FROM fam"))
def jittered(spark, sf_dir):
    """Normal noise on every vertex, by hash."""
    v = synthetic.jitter(_fam(spark, sf_dir), 0.5, 3)
    return rounded(v.select("winding", "row", "col", "z", "y", "x"), 2)


@query(S.with_(S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), last="SELECT winding, CAST(count(*) AS BIGINT) AS n FROM hol WHERE valid AND abs(CAST(z AS DOUBLE) - 40e0) <= 6e0 GROUP BY winding"))
def slab_vertices(spark, sf_dir):
    """The vertices inside a slab of z, what an overlay picture would show (K4)."""
    return _holed(spark, sf_dir).where(F.col("valid") & (F.abs(F.col("z").cast("double") - 40.0) <= 6.0)).groupBy("winding").agg(F.count("*").alias("n"))


# Scores against evidence


def _points(spark, sf_dir, clean=False, inputs=True):
    family = _fam(spark, sf_dir, clean)
    known = scoring.as_surfaces(_patches(spark, sf_dir).where("number % 3 = 0")) if inputs else None
    return scoring.point_scores(_patches(spark, sf_dir), family, known)


_SCORED = S.scored()


@query(S.with_(*S.scored(False, False), last=S.named("SELECT patch, r AS row, c AS col, round(dist, 5) AS dist, winding, round(u, 6) AS u FROM pts")))
def nearest_face(spark, sf_dir):
    return rounded(_points(spark, sf_dir, inputs=False).select("patch", "row", "col", F.round("dist", 5).alias("dist"), "winding", "u"))


@query(S.with_(*_SCORED, last=S.named("SELECT patch, r AS row, c AS col, round(input_dist, 5) AS input_dist FROM pts")))
def leakage_dist(spark, sf_dir):
    return _points(spark, sf_dir).select("patch", "row", "col", F.round("input_dist", 5).alias("input_dist"))


@query(S.with_(*_SCORED, last="SELECT " + ", ".join(f"round(avg(CASE WHEN input_dist <= {t} THEN 1.0 ELSE 0.0 END), 6) AS within_{str(t).replace('.', '_')}" for t in scoring.LEAKAGE) + " FROM pts"))
def leakage_profile(spark, sf_dir):
    return rounded(scoring.leakage_profile(_points(spark, sf_dir)))


@query(S.with_(*S.scored(False, False), last=S.named("SELECT patch, r AS row, c AS col, round(angle, 4) AS angle FROM pts")))
def normal_angles(spark, sf_dir):
    return _points(spark, sf_dir, inputs=False).select("patch", "row", "col", F.round("angle", 4).alias("angle"))


@query(S.with_(*S.scored(False, False), S.modal("m", "pts", "patch", "winding"), last=S.named("SELECT patch, mode, round(share, 6) AS share, n FROM m")))
def modal_winding(spark, sf_dir):
    from quadlens.functions.stats import modes

    return rounded(modes(_points(spark, sf_dir, inputs=False), ["patch"], "winding"))


@query(S.with_(*S.scored(False, False), *S.agreement(), last=S.named("SELECT patch, round(agreement, 6) AS agreement FROM agr")))
def winding_agreement(spark, sf_dir):
    return rounded(scoring.winding_agreement(_points(spark, sf_dir, inputs=False)))


@query(S.with_(*S.scored(False, False), *S.sheets()[:3], last=S.named("SELECT patch, CASE way WHEN 0 THEN 'row' ELSE 'col' END AS way, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (abs(du) <= 0.5) AS BIGINT) AS n_smooth FROM e0 GROUP BY ALL")))
def grid_adjacency(spark, sf_dir):
    e = mesh.grid_edges(_points(spark, sf_dir, inputs=False), ["patch"], ["u"])
    return e.groupBy("patch", "way").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("u2") - F.col("u")) <= 0.5).alias("n_smooth"))


@query(S.with_(*S.scored(False, False), *S.sheets()[:5], last=S.named("SELECT patch, " + S.rnd("drift_row", "drift_col") + " FROM drift")))
def drift_medians(spark, sf_dir):
    return rounded(scoring.drift_medians(_points(spark, sf_dir, inputs=False)))


@query(S.with_(*S.scored(False, False), *S.sheets(), last=S.named("SELECT patch, round(sheet_consistency, 6) AS share FROM share")))
def sheet_components(spark, sf_dir):
    return rounded(sheets.largest_share(sheets.with_sheets(_points(spark, sf_dir, inputs=False), ["patch"]), ["patch"]))


_PER_PATCH = [*S.sheets(), S.modal("mw", "pts", "patch", "winding"), *S.agreement(), f"base AS (SELECT patch, CAST(count(*) AS BIGINT) AS n_points, {S.quantiles('dist', 'dist')}, avg(CASE WHEN dist <= 6 THEN 1.0 ELSE 0.0 END) AS frac_within_tau, quantile_cont(angle, 0.5) AS angle_p50, quantile_cont(angle, 0.9) AS angle_p90, CAST(count(*) FILTER (input_dist > 2) AS BIGINT) AS n_unseen FROM pts GROUP BY patch)",
              "scores AS (SELECT base.*, mw.mode AS modal_winding, mw.share AS single_winding, sheet_consistency, agreement FROM base JOIN mw USING (patch) JOIN share USING (patch) LEFT JOIN agr USING (patch))"]


_UNSEEN = [", ".join(f"quantile_cont({v}, {q}) FILTER (input_dist > 2) AS unseen_{v}_{n}" for v, q, n in (("dist", 0.5, "p50"), ("dist", 0.9, "p90"), ("dist", 0.99, "p99"), ("angle", 0.9, "p90"))),
           "max(dist) FILTER (input_dist > 2) AS unseen_dist_max, avg(CASE WHEN dist <= 6 THEN 1.0 ELSE 0.0 END) FILTER (input_dist > 2) AS unseen_frac_within_tau"]
UNSEEN = [f"un AS (SELECT patch, {', '.join(_UNSEEN)} FROM pts GROUP BY patch)", "us AS (SELECT patch, max(n) / sum(n) AS unseen_sheet_consistency FROM (SELECT patch, sheet, count(*) AS n FROM pts JOIN sheet USING (patch, r, c) WHERE input_dist > 2 GROUP BY ALL) GROUP BY patch)"]
_NAMES = ["dist_p50", "dist_p90", "dist_p99", "dist_max", "frac_within_tau", "angle_p50", "angle_p90", "single_winding", "sheet_consistency", "agreement", "unseen_dist_p50", "unseen_dist_p90", "unseen_dist_p99", "unseen_dist_max", "unseen_frac_within_tau", "unseen_angle_p90", "unseen_sheet_consistency"]


@query(S.with_(*_SCORED, *_PER_PATCH, *UNSEEN, last=S.named(f"SELECT patch, n_points, n_unseen, modal_winding, {S.rnd(*_NAMES, digits=4)} FROM scores JOIN un USING (patch) LEFT JOIN us USING (patch)")))
def patch_scores(spark, sf_dir):
    return rounded(scoring.patch_scores(cut(sheets.with_sheets(_points(spark, sf_dir), ["patch"]))), 4)


@query(S.with_(*_SCORED, *_PER_PATCH, last=f"""SELECT n_patches, n_points, {S.rnd('mean_single_winding', 'min_single_winding', 'mean_sheet', 'min_sheet', 'mean_agreement', 'dist_p50', 'dist_p90', 'dist_p99', 'dist_max', 'frac_within_tau', 'angle_p90', digits=4)} FROM
 (SELECT CAST(count(*) AS BIGINT) AS n_patches, CAST(sum(n_points) AS BIGINT) AS n_points, sum(single_winding * n_points) / sum(n_points) AS mean_single_winding, min(single_winding) AS min_single_winding, sum(sheet_consistency * n_points) / sum(n_points) AS mean_sheet, min(sheet_consistency) AS min_sheet, sum(agreement * n_points) / sum(n_points) FILTER (agreement IS NOT NULL) AS mean_agreement FROM scores),
 (SELECT {S.quantiles('dist', 'dist')}, avg(CASE WHEN dist <= 6 THEN 1.0 ELSE 0.0 END) AS frac_within_tau, quantile_cont(angle, 0.9) AS angle_p90 FROM pts)"""))
def score_aggregate(spark, sf_dir):
    points = cut(sheets.with_sheets(_points(spark, sf_dir), ["patch"]))
    return rounded(scoring.aggregate(points, scoring.patch_scores(points)), 4)


@query(S.with_(*_SCORED, *S.sheets(), "far AS (SELECT pts.*, sheet FROM pts JOIN sheet USING (patch, r, c) WHERE input_dist > 2)", "enough AS (SELECT patch, count(*) AS k FROM far GROUP BY patch HAVING count(*) >= 8)", "kept AS (SELECT far.* FROM far JOIN enough USING (patch))",
               "sh AS (SELECT patch, max(n) / sum(n) AS share FROM (SELECT patch, sheet, count(*) AS n FROM kept GROUP BY ALL) GROUP BY patch)",
               last=f"""SELECT n_patches, {S.rnd('mean_sheet', 'min_sheet', digits=4)}, n_points, {S.rnd('dist_p50', 'dist_p90', 'dist_p99', 'dist_max', 'frac_within_tau', 'angle_p90', digits=4)}, n_all - n_patches AS n_excluded FROM
 (SELECT CAST(count(*) AS BIGINT) AS n_patches, sum(share * k) / sum(k) AS mean_sheet, min(share) AS min_sheet FROM sh JOIN enough USING (patch)),
 (SELECT CAST(count(*) AS BIGINT) AS n_points, {S.quantiles('dist', 'dist')}, avg(CASE WHEN dist <= 6 THEN 1.0 ELSE 0.0 END) AS frac_within_tau, quantile_cont(angle, 0.9) AS angle_p90 FROM kept), (SELECT count(DISTINCT patch) AS n_all FROM pts)"""))
def unseen_aggregate(spark, sf_dir):
    return rounded(scoring.unseen_aggregate(cut(sheets.with_sheets(_points(spark, sf_dir), ["patch"]))), 4)


@query(S.with_(*S.scored(False, False), "cor AS (SELECT patch, r + i AS r, c + j AS c, winding FROM pts, range(2) a(i), range(2) b(j))", last=S.named('SELECT patch, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, min(winding) AS winding FROM cor GROUP BY patch, r, c HAVING min(winding) = max(winding)')))
def vertex_labels(spark, sf_dir):
    return mesh.vertex_labels(_points(spark, sf_dir, inputs=False).select("patch", "row", "col", "winding"), ["patch"], "winding")


_SHIFTED = [*S.scored(True, False), S.radially("fam2", "fam", "10e0"), *S.faces("f2", "fam2"), *S.nearest("near2", "pn", ["patch", "r", "c"], "f2")]


@query(S.with_(*_SHIFTED, "d AS (SELECT b.patch, b.winding - a.winding AS shift, b.dist - a.dist AS more FROM near a JOIN near2 b ON a.patch = b.patch AND a.r = b.r AND a.c = b.c)", last=S.named("SELECT patch, CAST(count(*) AS BIGINT) AS n, round(median(shift), 6) AS median_shift, round(avg(CASE WHEN shift = -1 THEN 1.0 ELSE 0.0 END), 6) AS frac_minus_one, round(avg(CASE WHEN shift = 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_zero, round(median(more), 4) AS median_more FROM d GROUP BY patch")))
def winding_shift_response(spark, sf_dir):
    """How assignments answer to all windings moving out by one pitch."""
    family, patches = _fam(spark, sf_dir), _patches(spark, sf_dir)
    points = scoring.patch_points(patches)
    keys = ["patch", "row", "col"]
    a = nearest_faces(points, mesh.faces(family), keys)
    b = nearest_faces(points, mesh.faces(synthetic.displace(family, 10.0)), keys)
    d = compare.paired_points(a, b, "patch", keys).select("patch", (F.col("face_winding2") - F.col("face_winding")).alias("shift"), (F.col("dist2") - F.col("dist")).alias("more"))
    from quadlens.functions.stats import fraction

    return rounded(d.groupBy("patch").agg(F.count("*").alias("n"), F.median("shift").alias("median_shift"), fraction(F.col("shift") == -1).alias("frac_minus_one"), fraction(F.col("shift") == 0).alias("frac_zero"), F.round(F.median("more"), 4).alias("median_more")))


#: Every patch beside a copy of itself, half a voxel farther out: pair is the patch's number.
OVERLAP = [S.patches("pat"), S.radially("cp", "pat", "5e-1", "number"), S.quads("q", "pat", "number"), S.centers("p0", "q"), "p AS (SELECT *, number AS pair FROM p0)",
           "other AS (SELECT CAST(number AS INTEGER) AS winding, r, c, z, y, x, valid FROM cp)", *S.faces("f0", "other"), "f AS (SELECT *, winding AS pair FROM f0)", *S.nearest("near", "p", ["pair", "r", "c"], "f", within="pair"),
           "edge AS (SELECT winding, r, c, (SELECT count(*) FROM f0_q b WHERE a.winding = b.winding AND abs(a.r - b.r) + abs(a.c - b.c) = 1) < 4 AS boundary FROM f0_q a)",
           "inner_ AS (SELECT near.* FROM near JOIN edge ON near.pair = edge.winding AND fr = edge.r AND fc = edge.c WHERE NOT boundary)"]


def overlapping(spark, sf_dir):
    """(patches with their copies, pairs: patch, partner, pair)."""
    pat = _patches(spark, sf_dir)
    copies = synthetic.displace(pat, 0.5).withColumn("patch", F.concat(F.lit("copy_"), "patch"))
    pairs = pat.select("patch", F.concat(F.lit("copy_"), "patch").alias("partner"), F.col("number").cast("int").alias("pair")).distinct()
    return pat.unionByName(copies), pairs


@query(S.with_(*OVERLAP, last="SELECT CAST(count(*) AS BIGINT) AS n, round(median(dist), 5) AS median, round(quantile_cont(dist, 0.95), 5) AS p95 FROM inner_"))
def overlap_pairs(spark, sf_dir):
    """Distances in the zone where patches overlap: nearest faces of a patch's own partner that are not on its boundary."""
    found = overlap.overlap_distances(*overlapping(spark, sf_dir))
    whole = exact_quantiles(cut(found), [], "dist", {"median": 0.5, "p95": 0.95})
    return rounded(whole, 5)


# Strips


def _strip_rows(spark, sf_dir):
    points = woven.strips(_table(spark, sf_dir, "part"))
    return points, strips.wrap_points(points, _fam(spark, sf_dir), intrinsic.umbilicus_table(spark, AXIS), (0.0, 60.0))


def _strip_sql() -> list[str]:
    return [
        S.strips("sp"),
        "sn AS (SELECT *, count(wind_a) OVER (PARTITION BY source, collection) AS na FROM sp)",
        "sk AS (SELECT source, collection, point, z AS pz, y AS py, x AS px, CASE WHEN na = 0 THEN 0e0 ELSE wind_a END AS wind_a FROM sn WHERE (na = 0 OR wind_a IS NOT NULL) AND z BETWEEN 0 AND 60)",
        S.family("fam"), *S.faces("f", "fam"), *S.nearest("sf", "sk", ["source", "collection", "point"], "f", ["u"]),
        S.axis(AXIS), "sj AS (SELECT sk.*, sf.dist, sf.u FROM sk JOIN sf USING (source, collection, point))", S.axis_at("sa", "sj", "pz"),
        "st AS (SELECT *, atan2(py - ay, px - ax) AS theta FROM sa)",
        "sd AS (SELECT *, theta - lag(theta) OVER (PARTITION BY source, collection ORDER BY point) AS step FROM st)",
        f"sm AS (SELECT *, (step + {S.num(3.141592653589793)}) - {S.T} * floor((step + {S.num(3.141592653589793)}) / {S.T}) - {S.num(3.141592653589793)} AS m0 FROM sd)",
        f"sx AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < {S.num(3.141592653589793)} THEN 0e0 ELSE (CASE WHEN m0 = -{S.num(3.141592653589793)} AND step > 0 THEN {S.num(3.141592653589793)} ELSE m0 END) - step END AS fix FROM sm)",
        f"su AS (SELECT *, (theta + sum(fix) OVER (PARTITION BY source, collection ORDER BY point)) / {S.T} AS turns FROM sx)",
        "sw AS (SELECT *, u - turns - wind_a AS wrap, dist <= 6 AS decidable FROM su)",
        "so AS (SELECT sw.*, wrap - mid AS off_, decidable AND abs(wrap - mid) < 0.5 AS agree FROM sw LEFT JOIN (SELECT source, collection, median(wrap) AS mid FROM sw WHERE decidable GROUP BY ALL) USING (source, collection))",
        """sv AS (SELECT p.source, p.collection, p.n_points, p.kind, p.n_dropped, coalesce(n_in_window, 0) AS n_in_window, coalesce(n_within_tau, 0) AS n_within_tau, coalesce(n_agree, 0) AS n_agree, dist_p50, dist_max, spread FROM
 (SELECT source, collection, count(*) AS n_points, CASE WHEN count(wind_a) > 0 THEN 1 ELSE 0 END AS kind, CASE WHEN count(wind_a) > 0 THEN count(*) - count(wind_a) ELSE 0 END AS n_dropped FROM sp GROUP BY ALL) p
 LEFT JOIN (SELECT source, collection, count(*) AS n_in_window, count(*) FILTER (decidable) AS n_within_tau, count(*) FILTER (agree) AS n_agree, quantile_cont(dist, 0.5) AS dist_p50, max(dist) AS dist_max, max(abs(off_)) FILTER (agree) AS spread FROM so GROUP BY ALL) w USING (source, collection))""",
    ]


_STRIPS = _strip_sql()


@query(S.with_(*_STRIPS, last="SELECT 'parts' AS source, collection, CAST(point AS BIGINT) AS point, round(turns, 6) AS turns, round(wrap, 5) AS wrap FROM sw"))
def strip_unwrap(spark, sf_dir):
    rows = _strip_rows(spark, sf_dir)[1]
    return rounded(rows.select("source", "collection", "point", "turns", F.round("wrap", 5).alias("wrap")))


@query(S.with_(*_STRIPS, last="SELECT 'parts' AS source, CAST(collection AS BIGINT) AS collection, " + S.STRIP_NAME + ", n_points, CASE kind WHEN 1 THEN 'relative' ELSE 'same-winding' END AS kind, n_dropped, n_in_window, n_within_tau, n_agree, " + S.rnd("dist_p50", "dist_max", "spread", digits=5) + " FROM sv"))
def strip_verdicts(spark, sf_dir):
    points, rows = _strip_rows(spark, sf_dir)
    return rounded(strips.verdicts(strips.judged(rows), points), 5)


@query(S.with_(*_STRIPS, last="SELECT CAST(collection AS BIGINT) AS collection, CAST(point AS BIGINT) AS point, round(off_, 5) AS off, CAST(round_even(off_, 0) AS INTEGER) AS off_rounded, round(dist, 5) AS dist FROM so WHERE decidable AND NOT agree"))
def strip_offenders(spark, sf_dir):
    bad = strips.offenders(strips.judged(_strip_rows(spark, sf_dir)[1]))
    return rounded(bad.select("collection", "point", F.col("offset").alias("off"), F.col("offset_rounded").alias("off_rounded"), "dist"), 5)


_POOL = "CAST(count(*) AS BIGINT) AS n_collections, CAST(count(*) FILTER (n_within_tau > 0) AS BIGINT) AS n_decidable, CAST(count(*) FILTER (n_within_tau > 0 AND n_agree = n_within_tau) AS BIGINT) AS n_perfect, CAST(count(*) FILTER (n_within_tau >= 2) AS BIGINT) AS n_informative, CAST(count(*) FILTER (n_within_tau >= 2 AND n_agree = n_within_tau) AS BIGINT) AS n_informative_perfect, CAST(sum(n_points) AS BIGINT) AS n_points, CAST(sum(n_in_window) AS BIGINT) AS n_in_window, CAST(sum(n_within_tau) AS BIGINT) AS n_within_tau, CAST(sum(n_agree) AS BIGINT) AS n_agree, round(max(spread), 5) AS spread_max, round(CASE WHEN sum(n_within_tau) > 0 THEN sum(n_agree) / sum(n_within_tau) END, 5) AS agreement"


@query(S.with_(*_STRIPS, last=f"SELECT CASE WHEN kind IS NULL THEN 'all' WHEN kind = 1 THEN 'relative' ELSE 'same-winding' END AS kind, {_POOL} FROM sv GROUP BY ROLLUP (kind)"))
def strip_rollup(spark, sf_dir):
    points, rows = _strip_rows(spark, sf_dir)
    return rounded(strips.pooled(strips.verdicts(strips.judged(rows), points)), 5)


@query(S.with_(*_STRIPS, "tt AS (SELECT *, dist <= tau AS dec2 FROM sw, (VALUES (2e0), (4e0), (6e0), (10e0), (20e0)) t(tau))", "tm AS (SELECT source, collection, tau, median(wrap) AS mid FROM tt WHERE dec2 GROUP BY ALL)",
               last="SELECT tau, CAST(count(*) FILTER (dec2) AS BIGINT) AS n_within_tau, CAST(count(*) FILTER (dec2 AND abs(wrap - mid) < 0.5) AS BIGINT) AS n_agree FROM tt LEFT JOIN tm USING (source, collection, tau) GROUP BY tau"))
def tau_sweep(spark, sf_dir):
    return strips.tau_sweep(_strip_rows(spark, sf_dir)[1])


@query(S.with_(*_STRIPS, last="SELECT decidable, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(pz, 0.5), 5) AS z_p50, round(min(pz), 5) AS z_min, round(max(pz), 5) AS z_max, CAST(count(*) FILTER (least(pz - 0, 60 - pz) <= 20) AS BIGINT) AS n_near_edge FROM sw GROUP BY decidable"))
def z_profile(spark, sf_dir):
    return rounded(strips.z_profile(strips.judged(_strip_rows(spark, sf_dir)[1]), (0.0, 60.0)), 5)


# Comparison of runs


@query(S.with_(
    *S.demo("famc", True), *S.gap_cells("famc", AXIS, "c_"), *S.demo("fam"), *S.gap_cells("fam", AXIS), f"ra AS ({_REPORT.replace('FROM cls', 'FROM c_cls')})", f"rb AS ({_REPORT})",
    last=" UNION ALL ".join(f"SELECT '{m}' AS metric, round(CAST(ra.{m} AS DOUBLE), 5) AS a, round(CAST(rb.{m} AS DOUBLE), 5) AS b, round(CAST(rb.{m} AS DOUBLE) - CAST(ra.{m} AS DOUBLE), 5) AS delta FROM ra, rb" for m in ("n_bins", "median_pitch", "n_violation", "n_collapsed", "n_inflated", "frac_violation", "frac_collapsed"))))
def report_delta(spark, sf_dir):
    """The clean family's report against the defective one's, metric by metric."""
    flat = lambda clean: compare.flattened(intrinsic.report(intrinsic.classed(intrinsic.gaps(*_cells(spark, sf_dir, clean)))))
    return rounded(compare.deltas(flat(True), flat(False)), 5)
