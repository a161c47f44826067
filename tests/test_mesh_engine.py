"""The mesh engine: registered queries against their SQL, the exact join against brute force, and planted defects."""

import math
import random

import pytest

duckdb = pytest.importorskip("duckdb")

from pyspark.sql import functions as F

from quadlens import plans
from quadlens.operators import compare, graph, intrinsic, mesh, nearest, ranks, sheets, splits, strips
from quadlens.operators.nearest import nearest_brute, nearest_faces
from quadlens.sources import synthetic

TABLES = "nation customer supplier orders part lineitem events documents labels embeddings".split()
#: Run here against their SQL; the driver compares all of them.
HELD = ["gen_family", "collapse_gap", "quad_centers", "boundary_faces", "split_combined", "intrinsic_report", "nearest_face", "lineitem_modes", "lineitem_topk", "events_unwrap", "family_keys", "docs_split", "audit_semi", "verdict_concordance", "lineitem_percentiles", "slot_bootstrap", "emb_nearest", "emb_nearest_by_label", "overlap_pairs", "patch_scores", "strip_verdicts", "events_interpolated", "lineitem_floor", "lineitem_sheets", "scenario_store", "props_records", "natural_order", "run_loader", "combined_loader", "patch_loader", "points_loader", "points_in_window", "axis_loader", "loader_stats", "z_center", "twin_surfaces", "split_files", "report_files", "unseen_blocks", "worst_patches", "skipped_patches", "strips_by_agreement", "sensitivity_floor", "pitch_blindness", "overlap_control", "sagitta_bound", "violated_bins_diff", "defect_matrix", "jittered", "slab_vertices", "winding_shift_response", "last_verdicts", "loader_sample"]


def cell(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", HELD)
def test_against_sql(spark, small, duck, name):
    got = plans.queries()[name](spark, small)
    cursor = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = [tuple(map(cell, r)) for r in cursor.fetchall()]
    rows = [tuple(cell(r[n]) for n in names) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_every_query_has_sql_or_a_test():
    """The bootstrap's draws are numpy's; test_scale_operators holds it to their distribution."""
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"paired_bootstrap"} and set(plans.oracle_sql()) <= set(plans.queries())


def surface(spark, points, winding=1):
    """A grid of (z, y, x) as vertices."""
    rows = [("s", winding, i, j, *map(float, p), True) for i, row in enumerate(points) for j, p in enumerate(row)]
    return spark.createDataFrame(rows, "surface string, winding int, row int, col int, z float, y float, x float, valid boolean")


@pytest.mark.parametrize("tile", [1 << 16, 40])
def test_nearest_equals_brute_force(spark, monkeypatch, tile):
    """A wavy surface, a decoy cloud of small faces beside one huge face, and points on shared edges; in one tile and in many."""
    monkeypatch.setattr(nearest, "TILE", tile)
    rng = random.Random(0)
    wavy = surface(spark, [[(i, j, 0.8 * math.sin(0.7 * i) + 0.6 * math.cos(0.5 * j)) for j in range(16)] for i in range(12)])
    small = [surface(spark, [[(k, 5 + k * 0.01, 5), (k, 5.01 + k * 0.01, 5)], [(k + 0.01, 5, 5), (k + 0.01, 5.01, 5)]], 10 + k) for k in range(3)]
    huge = surface(spark, [[(-200, -200, -1.5), (-200, 200, -1.5)], [(200, -200, -1.5), (200, 200, -1.5)]], 20)
    family = wavy
    for s in [*small, huge]:
        family = family.unionByName(s)
    points = [(i, *[rng.uniform(-4, 16) for _ in "zyx"]) for i in range(60)] + [(100 + i, float(i), float(i), 0.3) for i in range(5)]
    points = spark.createDataFrame(points, "k int, pz double, py double, px double")
    faces = mesh.faces(family).cache()
    key = lambda r: (r.k, round(r.dist, 9), r.face_winding, r.face_row, r.face_col, r.face_block)
    assert sorted(map(key, nearest_faces(points, faces, ["k"]).collect())) == sorted(map(key, nearest_brute(points, faces, ["k"]).collect()))


def test_planted_defects_fire(spark):
    axis = intrinsic.umbilicus_table(spark, [(0.0, 0.0, 0.0)])

    def report(family):
        return intrinsic.report(intrinsic.classed(intrinsic.gaps(intrinsic.binned_radius(family, axis), family))).first()

    clean, bad = report(synthetic.demo(spark, True)), report(synthetic.demo(spark))
    assert (clean.n_violation, clean.n_collapsed, clean.n_inflated) == (0, 0, 0) and abs(clean.median_pitch - 10) < 0.2
    assert (bad.n_violation, bad.n_collapsed, bad.n_inflated) == (80, 60, 0)


def test_sheet_labels():
    import numpy as np

    row, col = (a.ravel() for a in np.mgrid[:6, :20])
    u = 10 + 0.006 * col
    assert len(set(sheets.sheet_labels(row, col, u))) == 1
    jump = np.where(col >= 10, u + 1.0, u)
    assert np.unique(sheets.sheet_labels(row, col, jump), return_counts=True)[1].tolist() == [60, 60]
    hole = (col < 5) | (col > 12)  # drift predicts the far side: one sheet
    assert len(set(sheets.sheet_labels(row[hole], col[hole], u[hole]))) == 1


def plain_sheets(row, col, u, jump=0.5):
    """Every pair of components, every pair of their cells."""
    import numpy as np

    at, label = {(r, c): i for i, (r, c) in enumerate(zip(row.tolist(), col.tolist()))}, {}

    def find(x, of):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    drift = []
    for i, j in ((1, 0), (0, 1)):
        steps = [(x, at[r + i, c + j]) for (r, c), x in at.items() if (r + i, c + j) in at]
        smooth = [(a, b) for a, b in steps if abs(u[b] - u[a]) <= jump]
        drift.append(float(np.median([u[b] - u[a] for a, b in smooth])) if smooth else 0.0)
        for a, b in smooth:
            a, b = find(a, label), find(b, label)
            label[max(a, b)] = min(a, b)
    members, merged = {}, {}
    for k in range(len(u)):
        members.setdefault(find(k, label), []).append(k)
    roots = sorted(members)
    for x, a in enumerate(roots):
        for b in roots[x + 1 :]:
            _, p, q = min(((row[p] - row[q]) ** 2 + (col[p] - col[q]) ** 2, p, q) for p in members[a] for q in members[b])
            if abs((u[q] - u[p]) - (drift[0] * (row[q] - row[p]) + drift[1] * (col[q] - col[p]))) <= jump:
                i, j = find(a, merged), find(b, merged)
                merged[max(i, j)] = min(i, j)
    return [find(find(k, label), merged) for k in range(len(u))]


def test_sheets_equal_brute_force(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    for trial in range(40):
        row, col = (a.ravel() for a in np.mgrid[: rng.integers(3, 13), : rng.integers(3, 13)])
        keep = rng.random(len(row)) < rng.choice([0.5, 0.8, 1.0])
        row, col = row[keep], col[keep]
        if not len(row):
            continue
        u = 10 + 0.03 * col + 0.02 * row + rng.integers(0, 3, len(row)) * rng.choice([0.4, 1.0]) * (trial % 3 > 0) + rng.normal(0, rng.choice([0.001, 0.1, 0.3]), len(row))
        monkeypatch.setattr(sheets, "MOST", int(rng.choice([1 << 20, 7])))
        assert sheets.sheet_labels(row, col, u).tolist() == plain_sheets(row, col, u)


def test_noise_is_many_sheets():
    """A patch of noise: tens of thousands of components of one quad each."""
    import numpy as np

    row, col = (a.ravel() for a in np.mgrid[:150, :150])
    u = np.random.default_rng(1).integers(0, 6, len(row)) * 1.0
    assert len(set(sheets.sheet_labels(row, col, u).tolist())) == 6


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 1.0, 2.0])) for g in "ab" for _ in range(501)] + [("c", 4.0), ("a", None)]
    got = {r.g: (r.n, r.q0, r.q5, r.q9) for r in ranks.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", {"q0": 0.0, "q5": 0.5, "q9": 0.9}).collect()}
    for g in "abc":
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g] == pytest.approx((len(v), *np.quantile(v, [0.0, 0.5, 0.9])))


def test_natural_order(spark):
    names = ["m2", "m10", "m1_x9", "m1_x10", "m01", "a", "m1"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in names], "n string").orderBy(compare.natural_key(F.col("n")), "n").collect()]
    assert got == ["a", "m01", "m1", "m1_x9", "m1_x10", "m2", "m10"]


def test_unwrap_equals_numpy(spark):
    import numpy as np

    theta = np.cumsum(np.random.default_rng(1).uniform(-2.5, 2.5, 50))
    theta = (theta + np.pi) % (2 * np.pi) - np.pi
    df = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate(theta)], "source string, point long, theta double")
    got = [r.turns for r in strips.with_turns(df, ["source"], "point").orderBy("point").collect()]
    assert np.allclose(np.array(got) * 2 * np.pi, np.unwrap(theta))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    label = {x: x for pair in links for x in pair}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} == label


def test_split_holds_families_together(spark):
    rows = [(f"p{i}", f"f{i // 2}", f"g{min(i, 20) if i != 37 else 3}", float(i)) for i in range(60)]
    items = spark.createDataFrame(rows, "name string, family string, geometry_hash string, z double")
    split = splits.z_stratified(splits.merged_families(items), 0.25, 5)
    assert split.count() == 60 and splits.crossing(split).isEmpty()
    assert split.groupBy("root").agg(F.count_distinct("side").alias("n")).where("n > 1").isEmpty()
    with pytest.raises(ValueError):
        splits.z_stratified(items, 0.7, 5)


def test_family_keys(spark):
    names = {"auto_grown_1_sel_a_1": "auto_grown_1", "x_v2_flatboi": "x", "a_copy_region_3": "a", "_copy": "_copy", "plain": "plain", "x" + "_copy_v2" * 30: "x"}
    df = spark.createDataFrame([(k,) for k in names], "name string")
    assert {r.name: r.key for r in df.select("name", splits.family_key(F.col("name")).alias("key")).collect()} == names


def test_split_numbers_families_in_ranges(spark):
    """Many families, ties in z: numbered as one global window would, but without gathering them in one task."""
    items = spark.range(3000).selectExpr("concat('f', id) AS name", "concat('f', id) AS root", "CAST(nullif(id % 7, 3) AS DOUBLE) AS z")
    split = splits.z_stratified(items, 0.2, 5)
    assert "SinglePartition" not in split._jdf.queryExecution().executedPlan().toString()
    order = sorted(items.collect(), key=lambda r: (r.z is not None, r.z or 0, r.root))
    block = {r.root: r.block for r in split.collect()}
    assert [block[r.root] for r in order] == [k // 5 for k in range(3000)]
    assert split.where("side = 'heldout'").count() == split.where("side = 'heldout'").select("block").distinct().count() == 600
    fam = splits.numbered(items, "z", "root")
    assert [r.n for r in fam.orderBy("z", "root").collect()] == list(range(3000)) and fam.select("total").distinct().first()[0] == 3000
    assert splits.z_stratified(items.limit(0), 0.2, 5).count() == 0


def test_bootstrap(spark):
    same = spark.createDataFrame([(f"i{k}", 1.0 + k, 5.0 + k, 5.0 + k) for k in range(8)], "item string, weight double, a double, b double")
    r = compare.paired_bootstrap(same, 200, 1).first()
    assert r.delta == r.lo == r.hi == 0 and r.excludes_zero  # the rule: both ends above zero, or neither
    more = same.withColumn("b", F.col("b") + 2)
    r = compare.paired_bootstrap(more, 200, 1).first()
    assert r.delta == pytest.approx(2) and r.lo == pytest.approx(2) and r.excludes_zero


def test_axis_between_points_to_the_last_digit(spark, small, duck, tmp_path):
    """Prices of whole cents give many halves in the seventh digit; prices that are no numbers are beyond the axis' ends."""
    duck.execute(f"COPY (SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT -i, v FROM (VALUES (1, 86361.51), (2, 'inf'::DOUBLE), (3, '-inf'::DOUBLE), (4, 'nan'::DOUBLE), (5, NULL), (6, 20000), (7, 1e306)) t(i, v)) TO '{tmp_path}/orders.parquet'")
    got = plans.queries()["umbilicus_interp"](spark, str(tmp_path))
    want = duckdb.connect()
    want.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = want.execute(plans.oracle_sql()["umbilicus_interp"]).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in want)
