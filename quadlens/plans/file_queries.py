"""Queries over files: written from surfaces woven from the driver's tables into the shared folder, read back by the readers."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from quadlens.functions.stats import rounded
from quadlens.operators import compare, intrinsic, overlap, scoring, sheets, splits, strips
from quadlens.operators.graph import cut, shared_path
from quadlens.operators.ranks import sagitta
from quadlens.plans import mesh_queries as M
from quadlens.plans import sql as S
from quadlens.sources import files, reports, synthetic

TABLE: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


def _named(v, names):
    """v with its surfaces named anew by winding."""
    name = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("winding"))
    return v.withColumn("surface", name)


_SMALL = [S.family("fam0"), "fam AS (SELECT * FROM fam0 WHERE winding < 13)"]


def _small(spark, sf_dir):
    return M._fam(spark, sf_dir).where("winding < 13")


@query(S.with_(*_SMALL, last=M._V.format("fam")))
def run_loader(spark, sf_dir):
    """A run with plain, spliced and tagged windings and a surface that is none: spliced ones are preferred."""
    v, path = _small(spark, sf_dir), shared_path(spark, "run")
    plain = _named(synthetic.displace(v.where("winding = 10"), 5.0), {10: "w010"})
    other = v.where("winding = 10").withColumn("surface", F.lit("notes"))
    files.write_surfaces(_named(v, {10: "w010_spliced", 11: "w011_tag", 12: "w012_spliced_tag"}).unionByName(plain).unionByName(other), path)
    return M._vertices(files.read_run(spark, path))


@query(S.with_(*M._WIDE, last="SELECT w AS winding, r AS row, c - j0 AS col FROM wide JOIN blocks ON c BETWEEN j0 AND j1"))
def combined_loader(spark, sf_dir):
    """A run as one wide surface with column ranges in its meta table."""
    path = shared_path(spark, "wide")
    files.write_surfaces(M._wide(spark, sf_dir), path, M.BLOCKS)
    return files.read_run(spark, path).select("winding", "row", "col")


@query(S.with_(S.patches("pat"), last="SELECT patch, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error FROM pat GROUP BY patch UNION ALL SELECT * FROM (VALUES ('flat', NULL, 'no valid quad'), ('twice', NULL, 'a cell is given twice')) t(patch, n, error)"))
def patch_loader(spark, sf_dir):
    """Good patches, and what is wrong with the others."""
    v, path = M._patches(spark, sf_dir).drop("number").withColumnRenamed("patch", "surface"), shared_path(spark, "patches")
    one = v.where("surface = 'patch0_w11'")
    bad = one.withColumn("surface", F.lit("flat")).withColumn("x", F.lit(math.nan).cast("float"))
    twice = one.withColumn("surface", F.lit("twice"))
    files.write_surfaces(v.unionByName(bad).unionByName(twice).unionByName(twice.where("row = 0")), path)
    patches, errors = files.read_patches(spark, path)
    good = patches.groupBy("patch").agg(F.count("*").alias("n")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(errors.select("patch", F.lit(None).cast("long").alias("n"), "error"))


_STRIP_TABLE = S.strips("sp")


def _strip_files(spark, sf_dir) -> str:
    """The strips as point-collection files of 50 collections each: some positions as zyx, some as p."""
    path = shared_path(spark, "strips")
    v = M.woven.strips(M._table(spark, sf_dir, "part"))
    at = F.struct(F.when(F.col("point") % 2 == 1, F.array("z", "y", "x")).alias("zyx"), F.when(F.col("point") % 2 == 0, F.array("x", "y", "z")).alias("p"), "wind_a")
    strip = v.groupBy("collection").agg(F.struct(F.first("name").alias("name"), F.map_from_entries(F.collect_list(F.struct(F.col("point").cast("string"), at))).alias("points")).alias("c"))
    found = strip.groupBy(F.floor(F.col("collection") / 50).alias("file")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("collection").cast("string"), "c"))).alias("collections"))
    found.select(F.to_json(F.struct(F.lit("1").alias(files.VERSION_KEY), "collections")).alias("value"), "file").write.partitionBy("file").text(path)  # a file holds 500 points at most
    return f"{path}/*"


@query(S.with_(_STRIP_TABLE, last="SELECT CAST(collection AS BIGINT) AS collection, " + S.STRIP_NAME + ", CAST(point AS BIGINT) AS point, " + S.rnd("z", "y", "x", "wind_a") + " FROM sp"))
def points_loader(spark, sf_dir):
    """Annotated strips from JSON."""
    return rounded(files.read_points(spark, _strip_files(spark, sf_dir)).select("collection", "name", "point", "z", "y", "x", "wind_a"))


@query(S.with_(_STRIP_TABLE, last="SELECT CAST(collection AS BIGINT) AS collection, CAST(count(*) AS BIGINT) AS n FROM sp WHERE z BETWEEN 24 AND 34 GROUP BY collection HAVING count(*) >= 4"))
def points_in_window(spark, sf_dir):
    """Strips cut to a window, kept with enough points."""
    return files.points_in_window(files.read_points(spark, _strip_files(spark, sf_dir)), (24.0, 34.0), 4).groupBy("collection").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_nationkey AS DOUBLE) AS z, CAST(n_regionkey AS DOUBLE) AS y, CAST(length(n_name) AS DOUBLE) AS x FROM nation")
def axis_loader(spark, sf_dir):
    """An axis from JSON: one control point a nation."""
    path = shared_path(spark, "axis")
    rows = M._table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.length("n_name")).collect()  # one axis, 25 points
    reports.write_text(spark, f"{path}/axis.json", json.dumps({"control_points": [list(r) for r in rows]}))
    return files.read_umbilicus(spark, f"{path}/axis.json")


_PER_SURFACE = "per AS (SELECT winding, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS share, max(r) + 1 AS h, max(c) + 1 AS w, min(CASE WHEN valid THEN z END) AS lo, max(CASE WHEN valid THEN z END) AS hi FROM hol GROUP BY winding)"


@query(S.with_(S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), _PER_SURFACE, last="SELECT CAST(count(*) AS BIGINT) AS n_surfaces, round(quantile_cont(share, 0.1), 6) AS valid_p10, round(quantile_cont(share, 0.5), 6) AS valid_p50, max(h) AS max_h, max(w) AS max_w, round(CAST(min(lo) AS DOUBLE), 6) AS z_min, round(CAST(max(hi) AS DOUBLE), 6) AS z_max FROM per"))
def loader_stats(spark, sf_dir):
    """What a folder of surfaces holds."""
    path = shared_path(spark, "holes")
    files.write_surfaces(M._holed(spark, sf_dir), path)
    return rounded(files.loader_stats(files.read_surfaces(spark, path)[0]))


@query(S.with_(S.family("fam"), "n AS (SELECT format('w{:03d}', winding) AS surface, CAST(count(*) AS BIGINT) AS n FROM fam GROUP BY ALL)", last="SELECT surface, n FROM n ORDER BY sha256(concat('5|', surface)) LIMIT 3"))
def loader_sample(spark, sf_dir):
    """A seeded sample of a folder's surfaces."""
    path = shared_path(spark, "sample")
    files.write_surfaces(M._fam(spark, sf_dir), path)
    return files.sampled(files.read_surfaces(spark, path)[0], 3, 5).groupBy("surface").agg(F.count("*").alias("n"))


@query(S.with_(S.family("fam"), S.holes("hol", "fam", 5, 4, 20, 90), last="SELECT format('w{:03d}', winding) AS surface, round((CAST(min(z) AS DOUBLE) + CAST(max(z) AS DOUBLE)) / 2, 6) AS z FROM hol WHERE valid GROUP BY winding"))
def z_center(spark, sf_dir):
    """The middle of each surface in z, from its meta row."""
    path = shared_path(spark, "centers")
    files.write_surfaces(M._holed(spark, sf_dir), path)
    return rounded(files.z_center(files.read_meta(spark, path), files.read_surfaces(spark, path)[0]))


_TWINS = "UNION ALL SELECT concat('a_', patch), number, r, c, z, y, x FROM pat WHERE number % 4 = 1"


@query(S.with_(S.patches("pat"), f"twice AS (SELECT patch, number, r, c, z, y, x FROM pat {_TWINS})", "sig AS (SELECT patch, string_agg(concat(r, ',', c, ',', z, ',', y, ',', x), ';' ORDER BY r, c) AS g FROM twice GROUP BY patch)", last="SELECT patch AS surface, min(patch) OVER (PARTITION BY g) AS root FROM sig"))
def twin_surfaces(spark, sf_dir):
    """Surfaces with the same geometry under two names are one family (content hashes, G3)."""
    v, path = M._patches(spark, sf_dir).withColumnRenamed("patch", "surface"), shared_path(spark, "twins")
    files.write_surfaces(v.unionByName(v.where("number % 4 = 1").withColumn("surface", F.concat(F.lit("a_"), "surface"))).drop("number"), path)
    items = files.surface_hashes(files.read_surfaces(spark, path)[0]).withColumn("family", F.col("surface"))
    return splits.merged_families(items).select("surface", "root")


@query(S.with_(*_SMALL, last="SELECT winding, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (valid) AS BIGINT) AS n_valid, 1 AS n_sides FROM fam GROUP BY winding"))
def split_files(spark, sf_dir):
    """A split written as two collections and a manifest, and found again: every surface is whole, on one side (K7, S8, R1 by PCG64)."""
    path = shared_path(spark, "split")
    v = cut(_small(spark, sf_dir))
    items = files.surface_hashes(v).join(v.groupBy("surface").agg(F.avg(F.col("z") + F.col("winding")).alias("z")), "surface").select(F.col("surface").alias("name"), F.col("surface").alias("family"), "geometry_hash", "z")
    reports.write_split(splits.z_stratified(splits.merged_families(items), 0.34, 5, True), v, path, {"seed": 5})
    sides = files.found_files(spark, f"{path}/manifest", "part-*")
    if sides.isEmpty():
        raise RuntimeError("the manifest was not written")
    back = None
    for side in ("fit", "heldout"):
        one = files.read_surfaces(spark, f"{path}/{side}")[0].withColumn("side", F.lit(side))
        back = one if back is None else back.unionByName(one)
    winding = F.regexp_extract("surface", r"w(\d+)", 1).cast("int")
    return back.groupBy(winding.alias("winding")).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_distinct("side").cast("int").alias("n_sides"))


_METRICS = ("n_bins", "median_pitch", "n_violation", "n_collapsed", "n_inflated", "frac_violation", "frac_collapsed")


@query(S.with_(*S.demo("fam"), *S.gap_cells("fam", M.AXIS), f"rb AS ({M._REPORT})", last=" UNION ALL ".join(f"SELECT 'intrinsic.{m}' AS metric, round(CAST({m} AS DOUBLE), 5) AS value FROM rb WHERE {m} IS NOT NULL" for m in _METRICS)))
def report_files(spark, sf_dir):
    """A report written as JSON, tables and Markdown, and read again."""
    path = shared_path(spark, "report")
    bins = cut(intrinsic.classed(intrinsic.gaps(*M._cells(spark, sf_dir))))
    reports.write_report(spark, path, {"tau": 6.0}, intrinsic=intrinsic.report(bins), worst=intrinsic.worst(bins), bins=bins)
    if not reports.in_step(spark, path):
        raise RuntimeError("report.md is not what report.json says")
    return rounded(reports.report_rows(spark, path), 5)


@query("""SELECT concat('m', p_partkey % 100, '_', p_size) AS name, CAST(p_partkey AS BIGINT) AS p_partkey FROM part ORDER BY p_partkey % 100, p_size, p_partkey LIMIT 20""")
def natural_order(spark, sf_dir):
    """Names in natural order: digit runs count as numbers."""
    name = F.concat(F.lit("m"), (F.col("p_partkey") % 100).cast("string"), F.lit("_"), F.col("p_size").cast("string"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("name"), F.col("p_partkey").cast("long").alias("p_partkey"))
    return part.orderBy(compare.natural_key(F.col("name")), "p_partkey").limit(20)


_UNSEEN = "SELECT patch, CAST(count(*) FILTER (input_dist > 2) AS BIGINT) AS n_unseen, " + ", ".join(f"round(quantile_cont(dist, {q}) FILTER (input_dist > 2), 4) AS unseen_dist_{n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + ", round(max(dist) FILTER (input_dist > 2), 4) AS unseen_dist_max, round(avg(CASE WHEN dist <= 6 THEN 1.0 ELSE 0.0 END) FILTER (input_dist > 2), 4) AS unseen_frac_within_tau, round(quantile_cont(angle, 0.9) FILTER (input_dist > 2), 4) AS unseen_angle_p90 FROM pts GROUP BY patch"


@query(S.with_(*M._SCORED, last=S.named(_UNSEEN)))
def unseen_blocks(spark, sf_dir):
    """Each patch's numbers over its unseen points, null without any."""
    scores = scoring.patch_scores(cut(sheets.with_sheets(M._points(spark, sf_dir), ["patch"])))
    return rounded(scores.select("patch", "n_unseen", *[c for c in scores.columns if c.startswith("unseen_") and "sheet" not in c]), 4)


@query(S.with_(*M._SCORED, "per AS (SELECT patch, quantile_cont(dist, 0.99) AS p99 FROM pts GROUP BY patch)", last=S.named("SELECT patch, round(p99, 4) AS dist_p99 FROM per ORDER BY p99 DESC, patch LIMIT 4")))
def worst_patches(spark, sf_dir):
    """The patches with the largest distances first."""
    scores = scoring.patch_scores(cut(sheets.with_sheets(M._points(spark, sf_dir), ["patch"])))
    return rounded(reports.worst_patches(scores, 4).select("patch", "dist_p99"), 4)


@query(S.with_(S.patches("pat"), S.quads("q", "pat", "patch"), S.centers("p", "q"), last="SELECT patch FROM p GROUP BY patch HAVING count(*) FILTER (pz BETWEEN 10 AND 40) = 0"))
def skipped_patches(spark, sf_dir):
    """Patches without a quad center in the z window are skipped and told (F1, Q2)."""
    return scoring.scored(M._patches(spark, sf_dir), M._fam(spark, sf_dir), z_range=(10.0, 40.0))[1]


@query(S.with_(*M._STRIPS, last="SELECT CAST(collection AS BIGINT) AS collection, round(CASE WHEN n_within_tau > 0 THEN n_agree / n_within_tau END, 5) AS agreement FROM sv ORDER BY coalesce(CASE WHEN n_within_tau > 0 THEN n_agree / n_within_tau END, 0), collection LIMIT 3"))
def strips_by_agreement(spark, sf_dir):
    """Strips with the least agreement first, those without a decidable point at the head."""
    points, rows = M._strip_rows(spark, sf_dir)
    v = strips.verdicts(strips.judged(rows), points).withColumn("agreement", F.try_divide("n_agree", "n_within_tau"))
    return rounded(reports.strips_by_agreement(v).limit(3).select("collection", "agreement"), 5)


# Sweeps

_FACTORS = (0.5, 0.7, 0.75, 0.85, 0.9)


@query(S.with_(*[x for i, f in enumerate(_FACTORS) for x in (S.family(f"a{i}"), S.collapsed(f"b{i}", f"a{i}", 16, 4.0, 5.0, f), *S.gap_cells(f"b{i}", M.AXIS, f"p{i}_"))],
               "sweep AS (" + " UNION ALL ".join(f"SELECT CAST({f} AS DOUBLE) AS factor, CAST(count(*) FILTER (kind = 'collapsed') AS BIGINT) AS n_collapsed FROM p{i}_cls" for i, f in enumerate(_FACTORS)) + ")",
               last="SELECT factor, n_collapsed, factor = (SELECT min(factor) FROM sweep WHERE n_collapsed > 0) AS floor FROM sweep"))
def sensitivity_floor(spark, sf_dir):
    """How strong a planted collapse has to be before it is seen (Q9)."""
    rows = None
    for f in _FACTORS:
        family = synthetic.collapse_gap(M._fam(spark, sf_dir), 16, 4.0, 5.0, f)
        bins = intrinsic.classed(intrinsic.gaps(intrinsic.binned_radius(family, intrinsic.umbilicus_table(spark, M.AXIS)), family))
        one = bins.agg(F.lit(f).alias("factor"), F.count_if(F.col("kind") == "collapsed").alias("n_collapsed"))
        rows = one if rows is None else rows.unionByName(one)
    rows = cut(rows)
    seen = rows.where("n_collapsed > 0").agg(F.min("factor").alias("least"))
    return rows.crossJoin(F.broadcast(seen)).select("factor", "n_collapsed", (F.col("factor") == F.col("least")).alias("floor"))  # one row


_SHIFTS = (5.0, 10.0, 20.0)


@query(S.with_(S.patches("pat"), *[S.radially(f"s{i}", "pat", f"{x}e0", "patch", ", label") for i, x in enumerate(_SHIFTS)], "allp AS (" + " UNION ALL ".join(f"SELECT concat('{x}|', patch) AS patch, r, c, z, y, x, label, valid FROM s{i}" for i, x in enumerate(_SHIFTS)) + ")",
               *S.demo("fam", True), S.quads("pq", "allp", "patch"), S.centers("pc", "pq"), *S.faces("f", "fam"), *S.nearest("pts", "pc", ["patch", "r", "c"], "f"), S.modal("m", "pts", "patch", "winding"),
               last="SELECT pts.patch, round(median(dist), 4) AS dist_p50, any_value(mode) AS modal_winding FROM pts JOIN m USING (patch) GROUP BY pts.patch"))
def pitch_blindness(spark, sf_dir):
    """Evidence moved by half a pitch, one and two: distances come back, the winding tells (Q10)."""
    v, moved = M._patches(spark, sf_dir).drop("number"), None
    for x in _SHIFTS:
        one = synthetic.displace(v, x).withColumn("patch", F.concat(F.lit(f"{x}|"), "patch"))
        moved = one if moved is None else moved.unionByName(one)
    points = cut(scoring.point_scores(moved, M._fam(spark, sf_dir)))
    from quadlens.functions.stats import modes

    modal = modes(points, ["patch"], "winding").select("patch", F.col("mode").alias("modal_winding"))
    return rounded(points.groupBy("patch").agg(F.median("dist").alias("dist_p50")).join(modal, "patch"), 4)


@query(S.with_(*M.OVERLAP, "per AS (SELECT pair, count(*) AS n, median(dist) AS p50, quantile_cont(dist, 0.95) AS p95 FROM inner_ GROUP BY pair HAVING count(*) >= 10)",
               last="SELECT CAST(count(*) AS BIGINT) AS n_pairs, round(median(p50), 5) AS median_p50, round(median(p95), 5) AS median_p95, round(avg(CASE WHEN p95 <= 2 THEN 1.0 ELSE 0.0 END), 5) AS share_close FROM per"))
def overlap_control(spark, sf_dir):
    """Every patch against its first known partner, over pairs with 10 points in the zone."""
    patches, pairs = M.overlapping(spark, sf_dir)
    listed = pairs.select("patch", F.array(F.lit("gone"), "patch", "partner").alias("partners"))
    found = overlap.first_partner(listed, patches.select("patch").distinct()).join(pairs.select("patch", "pair"), "patch")
    return rounded(overlap.overlap_report(overlap.overlap_distances(patches, found), least=10), 5)


@query("SELECT p_partkey, round(p_retailprice * (1 - cos(p_size * 0.01e0 / 2)), 6) AS sag FROM part")
def sagitta_bound(spark, sf_dir):
    """What flat faces add to a distance from an arc."""
    arcs = M._table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("r"), (F.col("p_size") * 0.01).alias("step"))
    return rounded(arcs.select("p_partkey", sagitta("r", "step").alias("sag")), 6)
