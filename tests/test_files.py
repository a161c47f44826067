"""Readers, writers and the command line."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quadlens import cli
from quadlens.operators import splits
from quadlens.sources import files, reports, synthetic


@pytest.fixture(scope="module")
def demo(spark, tmp_path_factory):
    """A demo run: meshes, patches, inputs and its report."""
    out = str(tmp_path_factory.mktemp("demo"))
    assert cli.main(["demo", "--out", out], spark) == 0
    return out


def test_demo_report(spark, demo):
    payload = json.loads(reports.read_text(spark, f"{demo}/report/report.json"))
    agg, own = payload["heldout_aggregate"], payload["intrinsic"]
    assert (own["n_violation"], own["n_collapsed"]) == (80, 60) and len(own["worst"]) == 20
    assert agg["n_patches"] == 9 and agg["n_patches_skipped"] == 0 and agg["evidence_leakage"]["n_input_patches"] == 3
    assert agg["unseen"]["n_points"] > 0 and spark.read.json(f"{demo}/report/patches").count() == 9
    assert reports.in_step(spark, f"{demo}/report")
    text = reports.read_text(spark, f"{demo}/report/report.md")
    assert "## Held-out evidence" in text and "### Worst bins" in text
    worst = [r.dist_p99 for r in reports.worst_patches(reports.report_patches(spark, f"{demo}/report")).collect()]
    assert worst == sorted(worst, reverse=True)
    assert reports.report_patches(spark, f"{demo}/report", True).columns[:2] == ["patch", "n_points"]


def test_exit_codes(spark, demo, tmp_path):
    score = ["score", "--meshes", f"{demo}/meshes", "--patches", f"{demo}/patches", "--out", str(tmp_path / "r")]
    assert cli.main([*score, "--tau", "nan"], spark) == 2
    assert cli.main([*score, "--z-range", "5,1"], spark) == 2
    assert cli.main([*score, "--z-range", "900,901"], spark) == 2
    assert cli.main(["score", "--meshes", str(tmp_path / "none"), "--patches", f"{demo}/patches", "--out", str(tmp_path / "r")], spark) == 2
    assert cli.main(["intrinsic", "--meshes", f"{demo}/meshes", "--umbilicus", "1,x", "--out", str(tmp_path / "i")], spark) == 2
    assert cli.main(["split", "--src", f"{demo}/patches", "--out", str(tmp_path / "s"), "--frac", "0.7"], spark) == 2
    assert cli.main(["compare", "--report-a", str(tmp_path / "x"), "--report-b", str(tmp_path / "y"), "--out", str(tmp_path / "c.md")], spark) == 2


def test_split_and_audits(spark, demo, tmp_path):
    out = str(tmp_path / "split")
    assert cli.main(["split", "--src", f"{demo}/patches", "--out", out, "--frac", "0.3"], spark) == 0
    meta = json.loads(reports.read_text(spark, f"{out}/split.json"))
    assert meta["n_patches"] == 9 and 1 <= meta["n_heldout"] <= 4
    fit, held = (set(r[0] for r in files.read_meta(spark, f"{out}/{side}").select("surface").collect()) for side in ("fit", "heldout"))
    assert len(fit | held) == 9 and not fit & held
    score = ["score", "--meshes", f"{demo}/meshes", "--out", str(tmp_path / "r"), "--manifest", out, "--no-intrinsic"]
    assert cli.main([*score, "--patches", f"{out}/heldout", "--fit-inputs", f"{out}/heldout"], spark) == 3
    assert cli.main([*score, "--patches", f"{demo}/patches"], spark) == 4
    assert cli.main([*score, "--patches", f"{out}/heldout", "--fit-inputs", f"{out}/fit"], spark) == 0
    bad = synthetic.patches(spark).where("patch = 'patch0_w11'").withColumn("x", F.lit(math.nan).cast("float")).withColumnRenamed("patch", "surface")
    good = synthetic.patches(spark).where("patch = 'patch1_w12'").withColumnRenamed("patch", "surface")
    files.write_surfaces(bad.unionByName(good), str(tmp_path / "inputs"))
    with_bad = ["--patches", f"{out}/heldout", "--fit-inputs", str(tmp_path / "inputs"), "--allow-unlisted-patches"]
    assert cli.main([*score[:5], *with_bad, "--no-intrinsic"], spark) == 5
    assert cli.main([*score[:5], *with_bad, "--no-intrinsic", "--allow-input-load-errors"], spark) == 0


def test_intrinsic_and_compare(spark, demo, tmp_path):
    clean = str(tmp_path / "clean")
    files.write_surfaces(synthetic.demo(spark, True), f"{clean}/meshes")
    assert cli.main(["intrinsic", "--meshes", f"{clean}/meshes", "--out", f"{clean}/report"], spark) == 0
    out = str(tmp_path / "c.md")
    assert cli.main(["compare", "--report-a", f"{clean}/report", "--report-b", f"{demo}/report", "--out", out], spark) == 0
    assert "intrinsic.n_violation | 0 | 80 | +80" in reports.read_text(spark, out)


def test_annotations(spark, demo, tmp_path):
    rows = [(13, 0.2 + 0.125 * n) for n in range(6)]
    at = lambda w, t: (20.0, math.sin(w * 2 * math.pi + t) * (10 * w + 10 * t / (2 * math.pi)), math.cos(w * 2 * math.pi + t) * (10 * w + 10 * t / (2 * math.pi)))
    points = {str(n): {"p": list(at(w, t))[::-1]} for n, (w, t) in enumerate(rows)}
    (tmp_path / "p.json").write_text(json.dumps({files.VERSION_KEY: "1", "collections": {"3": {"name": "same", "points": points}}}))
    assert cli.main(["annotations", "--meshes", f"{demo}/meshes", "--pcl", str(tmp_path / "p.json"), "--out", str(tmp_path / "a")], spark) == 0
    payload = json.loads(reports.read_text(spark, str(tmp_path / "a/annotations.json")))
    assert payload["pooled"]["all"]["n_points"] == 6 and payload["pooled"]["all"]["n_collections"] == 1
    (tmp_path / "old.json").write_text(json.dumps({files.VERSION_KEY: "0", "collections": {}}))
    assert cli.main(["annotations", "--meshes", f"{demo}/meshes", "--pcl", str(tmp_path / "old.json"), "--out", str(tmp_path / "b")], spark) == 2


def test_run_variants(spark, tmp_path):
    v = synthetic.family(spark, windings=1, z_count=3, theta_count=5)
    both = v.withColumn("surface", F.lit("w010")).unionByName(v.withColumn("surface", F.lit("w010_spliced_a")))
    pick = lambda variant: files.run_windings(both, variant).select("surface").distinct().first()[0]
    assert (pick("spliced"), pick("any"), pick("plain")) == ("w010_spliced_a", "w010_spliced_a", "w010")
    with pytest.raises(ValueError, match="same winding"):
        files.run_windings(both.unionByName(v.withColumn("surface", F.lit("w10_b"))))
    with pytest.raises(ValueError):
        files.run_windings(both, "other")
    files.write_surfaces(v.withColumn("surface", F.lit("notes")), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        files.read_run(spark, str(tmp_path / "x"))


def test_axes(spark, tmp_path):
    assert [tuple(r) for r in files.read_umbilicus(spark, "3,4").collect()] == [(0.0, 3.0, 4.0)]
    for text in ("[1, 2]", "[[1, 2]]", '{"points": []}', "[]"):
        (tmp_path / "a.json").write_text(text)
        with pytest.raises(ValueError):
            files.read_umbilicus(spark, str(tmp_path / "a.json"))


def test_pcg64_split(spark):
    import numpy as np

    items = spark.range(40).selectExpr("concat('f', lpad(id, 2, '0')) AS name", "concat('f', lpad(id, 2, '0')) AS root", "CAST(id AS DOUBLE) AS z")
    rng = np.random.default_rng(7)
    want = {f"f{5 * b + int(rng.integers(0, 5)):02d}" for b in range(8)}
    assert {r.name for r in splits.z_stratified(items, 0.2, 7, True).where("side = 'heldout'").collect()} == want
