"""Command line: score, intrinsic, annotations, split, compare, demo.

Exit codes: 0 fine, 2 bad input, 3 a held-out surface among the fit inputs, 4 a scored patch that is not held out,
5 an input that cannot be read. Everything is checked before anything is loaded.
"""

from __future__ import annotations

import argparse
import math
import sys

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quadlens.operators import intrinsic, scoring, sheets, splits, strips
from quadlens.operators.graph import cut
from quadlens.sources import files, reports, synthetic


class Refused(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


def positive(name: str, value: float) -> float:
    if not (value > 0 and math.isfinite(value)):
        raise Refused(2, f"--{name} must be a number above 0")
    return value


def window(given: str | None) -> tuple[float, float] | None:
    if given is None:
        return None
    try:
        low, high = map(float, given.split(","))
    except ValueError:
        raise Refused(2, "--z-range is LOW,HIGH") from None
    if not low <= high:
        raise Refused(2, "--z-range must not be empty")
    return low, high


def loaded(what, *args):
    try:
        return what(*args)
    except (ValueError, OSError, AnalysisException) as e:
        raise Refused(2, str(e).splitlines()[0]) from None


def axis_of(spark, given):
    return loaded(files.read_umbilicus, spark, given or "0,0")


def intrinsic_parts(spark, family, umbilicus):
    if family.select("winding").distinct().limit(2).count() < 2:
        raise Refused(2, "the order of windings needs two of them")
    bins = cut(intrinsic.classed(intrinsic.gaps(intrinsic.binned_radius(family, umbilicus), family)))
    if bins.isEmpty():
        raise Refused(2, "no bin holds two neighbouring windings")
    return intrinsic.report(bins), intrinsic.worst(bins), bins


def score(spark, a) -> int:
    tau, unseen, z = positive("tau", a.tau), positive("unseen-min-dist", a.unseen_min_dist), window(a.z_range)
    umbilicus = axis_of(spark, a.umbilicus)
    manifest = loaded(lambda: spark.read.json(f"{a.manifest}/manifest")) if a.manifest else None
    family = cut(loaded(files.read_run, spark, a.meshes, a.variant))
    patches, errors = loaded(files.read_patches, spark, a.patches)
    inputs = None
    if a.fit_inputs:
        inputs, bad = loaded(files.read_patches, spark, a.fit_inputs)
        if not a.allow_input_load_errors and (first := bad.first()):
            raise Refused(5, f"input {first['patch']}: {first['error']}")
    if manifest is not None:
        held = manifest.where("side = 'heldout'")
        hashed = lambda p: files.surface_hashes(p.withColumnRenamed("patch", "surface"))
        if inputs is not None and (hit := splits.audit_inputs(hashed(inputs), held).first()):
            raise Refused(3, f"{hit['surface']} is held out and among the fit inputs")
        if not a.allow_unlisted_patches and (hit := splits.audit_scored(hashed(patches), held).first()):
            raise Refused(4, f"{hit['surface']} is scored but not held out")
    points, skipped = scoring.scored(patches, family, inputs, z)
    points = cut(sheets.with_sheets(points, ["patch"]))
    if points.isEmpty():
        raise Refused(2, "no patch has a point to score (see --z-range)")
    scores = cut(scoring.patch_scores(points, tau, unseen))
    aggregate = scoring.full_aggregate(points, scores, skipped, tau, unseen, inputs)
    parts = {}
    if not a.no_intrinsic and family.select("winding").distinct().limit(2).count() == 2:
        parts = dict(zip(("intrinsic", "worst", "bins"), intrinsic_parts(spark, family, umbilicus)))
    meta = {"meshes": a.meshes, "patches": a.patches, "tau": tau, "variant": a.variant, "z_range": a.z_range, "n_patch_errors": errors.count(), "unseen_min_dist": unseen}
    reports.write_report(spark, a.out, meta, aggregate, scores, **parts)
    print(f"report: {a.out}/report.json")
    return 0


def intrinsic_only(spark, a) -> int:
    umbilicus = axis_of(spark, a.umbilicus)
    family = cut(loaded(files.read_run, spark, a.meshes, a.variant))
    report, worst, bins = intrinsic_parts(spark, family, umbilicus)
    reports.write_report(spark, a.out, {"meshes": a.meshes, "variant": a.variant}, intrinsic=report, worst=worst, bins=bins)
    print(f"report: {a.out}/report.json")
    return 0


def annotations(spark, a) -> int:
    tau, z = positive("tau", a.tau), window(a.z_range)
    umbilicus = axis_of(spark, a.umbilicus)
    family = cut(loaded(files.read_run, spark, a.meshes, a.variant))
    try:
        points = cut(files.read_points(spark, *a.pcl))
    except (PySparkException, OSError) as e:
        raise Refused(2, str(e).splitlines()[0]) from None
    if points.isEmpty():
        raise Refused(2, "no annotated point was read")
    rows = cut(strips.judged(strips.wrap_points(points, family, umbilicus, z), tau))
    verdicts = cut(strips.verdicts(rows, points))
    reports.write_strips(spark, a.out, {"meshes": a.meshes, "tau": tau, "z_range": a.z_range}, verdicts, strips.offenders(rows), strips.pooled(verdicts))
    print(f"report: {a.out}/annotations.json")
    return 0


def split(spark, a) -> int:
    if not 0 < a.frac <= 0.5:
        raise Refused(2, "--frac must be above 0 and at most 0.5")
    vertices, _ = loaded(files.read_surfaces, spark, a.src)
    vertices = cut(vertices)
    meta = files.read_meta(spark, a.src)
    items = files.z_center(meta, vertices).join(files.surface_hashes(vertices), "surface").select(F.col("surface").alias("name"), "z", "geometry_hash", splits.family_key(F.col("surface")).alias("family"))
    items = cut(items)
    if items.limit(2).count() < 2:
        raise Refused(2, "a split needs two patches")
    done = cut(splits.z_stratified(splits.merged_families(items), a.frac, a.seed, True))
    if not splits.crossing(done).isEmpty():
        raise RuntimeError("a geometry is on both sides")
    print(reports.write_split(done, vertices, a.out, {"seed": a.seed, "fraction": a.frac}))
    return 0


def compare(spark, a) -> int:
    try:
        reports.compare(spark, a.report_a, a.report_b, a.out)
    except (ValueError, OSError, AnalysisException) as e:
        raise Refused(2, str(e).splitlines()[0]) from None
    print(f"comparison: {a.out}")
    return 0


def demo(spark, a) -> int:
    patches = synthetic.patches(spark).withColumnRenamed("patch", "surface")
    files.write_surfaces(synthetic.demo(spark, a.clean), f"{a.out}/meshes")
    files.write_surfaces(patches, f"{a.out}/patches")
    files.write_surfaces(patches.where(F.col("surface").rlike("^patch[012]_")), f"{a.out}/inputs")
    given = ["score", "--meshes", f"{a.out}/meshes", "--patches", f"{a.out}/patches", "--fit-inputs", f"{a.out}/inputs", "--out", f"{a.out}/report"]
    return score(spark, parser().parse_args(given))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadlens", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *names, **kinds):
        c = sub.add_parser(kinds.pop("name"), help=kinds.pop("help"))
        for n in names:
            c.add_argument(f"--{n}", required=True)
        for n, options in kinds.items():
            c.add_argument(f"--{n.replace('_', '-')}", **options)
        c.set_defaults(run=run)

    flag, number = {"action": "store_true"}, lambda x: {"type": float, "default": x}
    family = {"variant": {"choices": files.VARIANTS, "default": "spliced"}, "umbilicus": {}}
    command(score, "meshes", "patches", "out", name="score", help="a run against held-out patches", tau=number(6.0), z_range={}, manifest={}, fit_inputs={}, unseen_min_dist=number(2.0), allow_unlisted_patches=flag, allow_input_load_errors=flag, no_intrinsic=flag, **family)
    command(intrinsic_only, "meshes", "out", name="intrinsic", help="order and spacing of a run's windings", **family)
    command(annotations, "meshes", "out", name="annotations", help="a run against annotated strips", pcl={"action": "append", "required": True}, tau=number(6.0), z_range={}, **family)
    command(split, "src", "out", name="split", help="held-out patches by family", frac=number(0.2), seed={"type": int, "default": 20260731})
    command(compare, "report-a", "report-b", "out", name="compare", help="two reports, metric by metric")
    command(demo, "out", name="demo", help="a generated run with planted defects, scored", clean=flag)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"quadlens {a.command}").getOrCreate()
    try:
        return a.run(spark, a)
    except Refused as e:
        print(f"quadlens: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main())
