"""Operators whose groups may be larger than a task, against plain versions on small inputs cut into many parts."""

import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quadlens.functions.vectors import triangle_distance
from quadlens.operators import compare, graph, mesh, nearest, overlap, scans, sheets, strips, sweeps, wide_sheets
from quadlens.operators.nearest import BoxTop, nearest_brute, nearest_faces

from quadlens import cli
from quadlens.sources import files, records, reports, store

from .test_mesh_engine import surface


def key(r):
    return r.k, r.grp, round(r.dist, 9), r.face_winding, r.face_row, r.face_col, r.face_block


@pytest.mark.parametrize(("tile", "top"), [(1 << 16, 1 << 12), (40, 1 << 12), (40, 6), (10, 1), (150, 2)])
def test_keyed_nearest(spark, monkeypatch, tile, top):
    """Groups of different sizes that lie across each other, one without points, points of a group without faces, null groups."""
    monkeypatch.setattr(nearest, "TILE", tile)
    monkeypatch.setattr(nearest, "TOP", top)
    rng, family = random.Random(1), None
    for g, (h, w) in enumerate([(14, 14), (3, 3), (2, 9), (10, 5)]):
        s = surface(spark, [[(i, j, math.sin(0.7 * i + g) + 0.6 * math.cos(0.5 * j)) for j in range(w)] for i in range(h)], 5 - g).withColumn("grp", F.lit(f"g{g}"))
        family = s if family is None else family.unionByName(s)
    faces = mesh.faces(family, ["grp"]).cache()
    rows = [(i, rng.choice(["g0", "g0", "g1", "g2"]), *[rng.uniform(-4, 16) for _ in "zyx"]) for i in range(70)] + [(100, "gone", 0.0, 0.0, 0.0), (101, None, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "k int, grp string, pz double, py double, px double").repartition(3)
    got = sorted(map(key, nearest_faces(points, faces, ["k"], ["u"], ["px"], within=["grp"]).collect()))
    want = []
    for g in ("g0", "g1", "g2"):
        want += map(key, nearest_brute(points.where(F.col("grp") == g), faces.where(F.col("grp") == g).drop("grp"), ["k", "grp"]).collect())
    assert got == sorted(want)
    assert nearest_faces(points, faces.where("grp = 'none'"), ["k"], within=["grp"]).count() == 0


def boxes(side):
    """Tiles on a bent surface, side x side of them, and the boxes above, as a table."""
    i, j = (a.ravel() for a in np.mgrid[:side, :side])
    height = 3 * np.sin(i / side * 6)
    low = np.stack([i, j, height], 1).astype(float)
    cell, high, level, out = np.stack([i, j, np.zeros_like(i)], 1), low + [1, 1, 0.3], 0, []
    while True:
        out += [(level, *c, *a, *b) for c, a, b in zip(cell.tolist(), low.tolist(), high.tolist())]
        if len(cell) == 1:
            return pa.table(dict(zip(["level", *nearest.CELL, *nearest.LOW, *nearest.HIGH], zip(*out)))), level
        cell >>= nearest.FAN
        cell, at = np.unique(cell, axis=0, return_inverse=True)
        up = np.full((len(cell), 3), np.inf), np.full((len(cell), 3), -np.inf)
        np.minimum.at(up[0], at.ravel(), low)
        np.maximum.at(up[1], at.ravel(), high)
        (low, high), level = up, level + 1


def test_boxes_visited_grow_with_the_log():
    rng, seen = np.random.default_rng(3), {}
    for side in (32, 128, 512):
        table, _ = boxes(side)
        tree = BoxTop(table, [], 0)
        p = np.stack([rng.uniform(0, side, 300), rng.uniform(0, side, 300), rng.uniform(-4, 4, 300)], 1)
        point, box, n = tree.asks(p, np.zeros(300, np.int64))
        near = np.array([nearest._bounds(x[None], tree.low[-1], tree.high[-1])[0].min() for x in p])
        own = np.full(300, np.inf)
        np.minimum.at(own, point, nearest._bounds(p[point], tree.low[-1][box], tree.high[-1][box])[0])
        assert (own == near).all()  # the nearest box is never dropped
        seen[side] = n / 300
    # 16 times the tiles each time, and about as many boxes more each time
    assert seen[512] - seen[128] < 1.5 * (seen[128] - seen[32]) and seen[512] < 512 * 512 / 500


@pytest.mark.parametrize("apart", [0.0, 4090.0, 4096.0, 40_960.0])
def test_overlap_of_pairs_far_apart(spark, apart):
    """Two equal pairs of patches give the same distances wherever they lie."""
    rows = []
    for k in range(2):
        for name, more in (("a", 0.0), ("b", 0.25)):
            rows += [(f"{name}{k}", i, j, float(3 * i + (apart if k == 0 else 0)), float(3 * j), more, True) for i in range(8) for j in range(8)]
    patches = spark.createDataFrame(rows, "patch string, row int, col int, z float, y float, x float, valid boolean")
    pairs = spark.createDataFrame([("a0", "b0", 0), ("a1", "b1", 1)], "patch string, partner string, pair int")
    found = overlap.overlap_distances(patches, pairs).collect()
    # 7 x 7 quads; those whose nearest face is at the partner's boundary go
    assert [sum(r.pair == k for r in found) for k in (0, 1)] == [25, 25]
    assert all(abs(r.dist - 0.25) < 1e-6 for r in found)


def plain_turns(rows):
    """(strip, order) -> turns, one row after the other."""
    out, last = {}, {}
    for g, i, theta in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        total, before = last.get(g, (0.0, None))
        if before is not None and abs(theta - before) >= math.pi:
            step = theta - before
            small = (step + math.pi) % (2 * math.pi) - math.pi
            total += (math.pi if small == -math.pi and step > 0 else small) - step
        last[g] = total, theta
        out[g, i] = (theta + total) / (2 * math.pi)
    return out


@pytest.mark.parametrize("ranges", [None, 1, 7, 40])
def test_unwrap_is_a_split_scan(spark, ranges):
    """One strip has half of all rows, many have one row, one is null; a piece of a strip is never longer than its range."""
    rng = random.Random(6)
    groups = ["big"] * 300 + [None] * 40 + [f"s{i % 60}" for i in range(260)]
    rows = [(g, i, rng.uniform(-math.pi, math.pi)) for i, g in enumerate(groups)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, theta double").repartition(5)
    got = {(r.g, r.i): r.turns for r in strips.with_turns(df, ["g"], "i", ranges=ranges).collect()}
    want = plain_turns(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    if ranges == 40:
        r = scans.Ranged(df, ["g"], ["i"], ranges)
        assert max(x["count"] for x in r.rows.groupBy("_part").count().collect()) < 60 and r.pieces.count() <= 2 * ranges


@pytest.mark.parametrize("ranges", [None, 1, 6, 30])
def test_interpolation_between_tables(spark, ranges):
    rng = random.Random(9)
    known = {(g, t): rng.uniform(-5, 5) for g in ("a", "a", "b", "c") for t in rng.sample(range(200), 60 if g == "a" else 5)}
    known["one", 50] = 3.0
    asked = [(k, rng.choice(["a", "a", "a", "b", "c", "one", "none"]), rng.choice([rng.randrange(200), rng.uniform(-20, 220)])) for k in range(200)] + [(900, "a", None), (901, None, 5.0)]
    left = spark.createDataFrame([(k, g, None if t is None else float(t)) for k, g, t in asked], "k int, g string, t double").repartition(4)
    right = spark.createDataFrame([(g, float(t), v) for (g, t), v in known.items()] + [("a", None, 1.0), ("a", 7.5, None)], "g string, t double, v double").repartition(4)
    got = {r.k: r.v for r in scans.interpolated(left, right, ["g"], "t", "v", ranges).collect()}
    assert len(got) == len(asked)
    for k, g, t in asked:
        own = sorted((x, v) for (h, x), v in known.items() if h == g)
        if not own or t is None:
            assert got[k] is None
        else:
            assert abs(got[k] - float(np.interp(t, *zip(*own)))) < 1e-9


@pytest.mark.parametrize("block", [3, 256])
def test_wide_sheets_equal_sheet_labels(spark, block):
    """Random grids with holes and jumps, each a patch, cut into blocks of 3 x 3 cells or taken whole."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for patch in range(14):
        row, col = (a.ravel() for a in np.mgrid[: rng.integers(3, 14), : rng.integers(3, 14)])
        keep = rng.random(len(row)) < rng.choice([0.5, 0.8, 1.0])
        row, col = row[keep], col[keep]
        u = 10 + 0.03 * col + 0.02 * row + rng.integers(0, 3, len(row)) * rng.choice([0.4, 0.7, 1.0]) * (patch % 3 > 0) + rng.normal(0, rng.choice([0.001, 0.1, 0.3]), len(row))
        label = sheets.sheet_labels(row, col, u)
        for r, c, x, s in zip(row.tolist(), col.tolist(), u.tolist(), label.tolist()):
            rows.append((f"p{patch}", r, c, x))
            want[f"p{patch}", r, c] = int(row[s]), int(col[s])
    points = spark.createDataFrame(rows, "patch string, row int, col int, u double").repartition(4)
    got = {(r.patch, r.row, r.col): (r.sheet_row, r.sheet_col) for r in wide_sheets.wide_sheets(points, ["patch"], block=block).collect()}
    assert got == want


def test_closest_cells(spark):
    """Against all pairs of cells, ties included; no more than a few cells a level stay in play for components far apart."""
    rng = np.random.default_rng(5)
    rows = [(k, int(r), int(c), float(r + c)) for k in range(6) for r, c in {(int(a), int(b)) for a, b in rng.integers(0, 12, (20, 2)) + [40 * (k % 3), 7 * k]}]
    cells = spark.createDataFrame(rows, "comp int, row int, col int, flat double")
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    got = {(r.a, r.b): (tuple(r.p), tuple(r.q)) for r in wide_sheets.closest_cells(spark.createDataFrame(pairs, "a int, b int"), cells).collect()}
    for a, b in pairs:
        best = min(((r - s) ** 2 + (c - t) ** 2, (r, c, f), (s, t, g)) for k, r, c, f in rows if k == a for m, s, t, g in rows if m == b)
        assert got[a, b] == best[1:]


def test_components_take_few_rounds(spark, monkeypatch):
    """A path whose labels lie in random order along it, a star, a loop and a pair: rounds grow with the log of the nodes."""
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    order = list(range(300))
    random.Random(2).shuffle(order)
    links = [*zip(order, order[1:]), *((500, 500 + i) for i in range(1, 40)), (700, 700), (801, 800), (800, 801)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{500 + i: 500 for i in range(40)}, 700: 700, 800: 800, 801: 800}
    assert len(rounds) <= 12


def test_bootstrap_kernel():
    """Counts of all ranges add up to the items, picks are spread evenly, and sums have the variance of a multinomial."""
    n, draws = 3 * compare.RANGE + 500, 400
    counts = np.stack([compare.range_counts(n, a, draws, 1, 7) for a in range(0, n, compare.RANGE)])
    assert (counts.sum(0) == n).all()
    share = np.array([compare.RANGE] * 3 + [500]) / n
    assert (abs(counts.mean(1) - n * share) < 5 * np.sqrt(n * share * (1 - share) / draws)).all()
    assert (abs(counts.var(1) / (n * share * (1 - share)) - 1) < 0.35).all()
    ones = np.eye(6)
    sums = compare.resampled_sums(ones, 6, 0, 4000, 0, 3)
    assert (sums.sum(1) == 6).all() and (abs(sums.mean(0) - 1) < 0.1).all() and (abs(sums.var(0) - 5 / 6) < 0.1).all()
    assert abs(np.corrcoef(sums[:, 0], sums[:, 1])[0, 1] + 1 / 5) < 0.08


def test_bootstrap_interval(spark):
    """One range or many give the interval that the linearised standard error tells; sides may have weights of their own."""
    rng = np.random.default_rng(1)
    a = rng.normal(10, 2, 300)
    b, w, v = a + rng.normal(0.5, 1, 300), rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    rows = [(i, float(w[i]), float(a[i]), float(b[i]), float(v[i])) for i in range(300)] + [(900, 1.0, None, 2.0, 1.0), (901, 1.0, 2.0, 3.0, None)]
    pairs = spark.createDataFrame(rows, "item int, weight double, a double, b double, weight_b double")
    ma, mb = (a * w).sum() / w.sum(), (b * v).sum() / v.sum()
    error = np.sqrt((((b - mb) * v / v.sum() - (a - ma) * w / w.sum()) ** 2).sum())
    for size in (4096, 64):
        r = compare.paired_bootstrap(pairs, 4000, 5, 700, size).first()
        assert abs(r.a - ma) < 1e-9 and abs(r.b - mb) < 1e-9 and r.excludes_zero == ((r.lo > 0) == (r.hi > 0))
        assert abs(r.lo - (mb - ma - 1.96 * error)) < 0.25 * error and abs(r.hi - (mb - ma + 1.96 * error)) < 0.25 * error


def test_sweep_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice("xyz")) for _ in range(400)]
    df = spark.createDataFrame([(None if v is None else float(v), k) for v, k in rows], "v double, k string")
    thresholds = spark.createDataFrame([(float(t),) for t in (-1, 0, 7, 7.5, 39, 60)], "t double")
    got = {r.t: (r.x, r.all) for r in sweeps.within_each(df, "v", thresholds, "t", {"x": "k = 'x'", "all": "true"}).collect()}
    assert got == {t: (sum(v is not None and v <= t and k == "x" for v, k in rows), sum(v is not None and v <= t for v, k in rows)) for t in (-1.0, 0.0, 7.0, 7.5, 39.0, 60.0)}
    counts = spark.createDataFrame([(1.0, 0, 1, 0), (2.0, 5, 6, 5), (3.0, 8, 8, 2), (4.0, 10, 10, 10)], "t double, a long, b long, s long")
    r = sweeps.floor_of(counts, "t", ("a", "b"), "s").first()
    assert (r.n_thresholds, r.band, r.floor, round(r.at_floor, 6)) == (4, 0.1, 3.0, 0.6)


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = lambda name, n: spark.range(n).withColumn("scenario", F.lit(name))
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "scenario string")
    assert store.missing(spark, path, wanted).count() == 3
    store.save(rows("a", 5).unionByName(rows("b", 7)), path, "scenario")
    store.save(rows("b", 3), path, "scenario")
    store.save(rows("b", 3), path, "scenario")
    assert {r.scenario: r["count"] for r in store.load(spark, path).groupBy("scenario").count().collect()} == {"a": 5, "b": 3}
    assert store.load(spark, path, scenario=["b", "z"]).count() == 3 and [r.scenario for r in store.missing(spark, path, wanted).collect()] == ["c"]
    with pytest.raises(ValueError, match="partitioned"):
        store.save(rows("a", 1), path)


def test_broken_records_and_files(spark, tmp_path):
    rows = [(1, '{"k": 4, "more": [1]}'), (2, '{"k": "four"}'), (3, None), (4, '{"k": 4'), (5, "[4]"), (6, "{}"), (7, '{"k": null}')]
    good, errors = records.parsed(spark.createDataFrame(rows, "i int, j string"), "j", "k long")
    assert {(r.i, r.k) for r in good.collect()} == {(1, 4), (6, None), (7, None)}
    assert {(r.i, r.error) for r in errors.collect()} == {(2, "malformed"), (3, "missing"), (4, "malformed"), (5, "malformed")}
    path = str(tmp_path / "files")
    df = spark.range(20).selectExpr("CAST(id AS INT) AS a", "CAST(id AS STRING) AS b")
    df.repartition(2).write.parquet(path)
    df.select("b").coalesce(1).write.parquet(f"{path}/lacking")
    (tmp_path / "files" / "broken.parquet").write_bytes(b"PAR1 no table PAR1")
    found, errors = records.read_files(spark, path, df.schema)
    assert sorted(r.a for r in found.collect()) == list(range(20))
    assert errors.count() == 2 and all(r.error for r in errors.collect())


def test_labels_of_zeros_are_none(spark, tmp_path):
    """A mask takes vertices out; a label grid of zeros is a single winding, one with other numbers is kept as it is."""
    rows = [(s, i, j, float(i), float(j), 0.0, True, 0.0 if s == "single" else float(j > 1), int((s, i, j) != ("masked", 0, 0))) for s in ("single", "two", "masked") for i in range(3) for j in range(4)]
    v = spark.createDataFrame(rows, "surface string, row int, col int, z float, y float, x float, valid boolean, label double, mask int")
    files.write_surfaces(v, str(tmp_path))
    got = files.read_surfaces(spark, str(tmp_path))[0].groupBy("surface").agg(F.count("label").alias("n"), F.count_if(F.col("label") == 0).alias("zero"), F.count_if("valid").alias("valid")).collect()
    assert {r.surface: (r.n, r.zero, r.valid) for r in got} == {"single": (0, 0, 12), "two": (12, 6, 12), "masked": (12, 6, 11)}


def test_compare_refuses(spark, tmp_path, capsys):
    payloads = {"good": {"heldout_aggregate": {"dist_p50": 1.0}, "intrinsic": None}, "list": [1, 2], "other": {"a": 1}, "odd": {"heldout_aggregate": [1], "intrinsic": None}, "apart": {"heldout_aggregate": None, "intrinsic": {"n_bins": 3}}}
    for name, payload in payloads.items():
        reports.write_text(spark, f"{tmp_path}/{name}/report.json", json.dumps(payload))
    reports.write_text(spark, f"{tmp_path}/text/report.json", "no json")
    run = lambda a, b: cli.main(["compare", "--report-a", f"{tmp_path}/{a}", "--report-b", f"{tmp_path}/{b}", "--out", f"{tmp_path}/out.md"], spark)
    assert run("good", "good") == 0
    for other in ("list", "other", "odd", "apart", "text", "absent"):
        assert run("good", other) == 2 and len(capsys.readouterr().err.strip().splitlines()) == 1


def test_report_bootstrap(spark, tmp_path):
    for name, more, weight in (("a", 0.0, 10), ("b", 1.0, 30)):
        spark.createDataFrame([(f"p{i}", weight + i, i + more, 4 if i % 2 else 0, i + 2 * more) for i in range(20)], "patch string, n_points long, dist_p50 double, n_unseen long, unseen_dist_p50 double").write.json(f"{tmp_path}/{name}/patches")
    r = reports.bootstrap(spark, f"{tmp_path}/a", f"{tmp_path}/b", "dist_p50", draws=500).first()
    want = [sum((w + i) * (i + m) for i in range(20)) / sum(w + i for i in range(20)) for w, m in ((10, 0), (30, 1))]
    assert abs(r.a - want[0]) < 1e-9 and abs(r.b - want[1]) < 1e-9 and r.lo < r.delta < r.hi
    r = reports.bootstrap(spark, f"{tmp_path}/a", f"{tmp_path}/b", "dist_p50", True, 500).first()
    assert (r.a, r.b, r.delta, r.excludes_zero) == (10.0, 12.0, 2.0, True)


def test_large_faces_are_measured_few_times(monkeypatch):
    """Faces as large as the whole cloud: all reach every point, but few are measured exactly."""
    rng, seen = np.random.default_rng(5), []
    corners, p = rng.normal(0, 1.3, (1500, 9)), rng.normal(0, 1.3, (300, 3))
    corners[:40, 6:] = corners[:40, 3:6] + 1e-7 * rng.normal(0, 1, (40, 3))  # slivers
    corners[40:60, 3:6] = corners[40:60, :3]  # no faces at all
    corners[60:70] = corners[70:80]  # ties
    g = corners.reshape(-1, 3, 3).mean(1)
    radius = np.linalg.norm(corners.reshape(-1, 3, 3) - g[:, None], axis=2).max(1)
    columns = {f"{n}{a}": corners[:, 3 * i + j] for i, n in enumerate("abc") for j, a in enumerate("zyx")} | {f"g{a}": g[:, j] for j, a in enumerate("zyx")}
    number = np.arange(len(g))
    faces = pa.table({**columns, "radius": radius, "face_winding": number % 3, "face_row": number, "face_col": number, "face_block": number % 2})
    monkeypatch.setattr(nearest, "triangle_distance", lambda q, *t: seen.append(len(q)) or triangle_distance(q, *t))
    points = pa.table({"k": np.arange(len(p)), **{f"p{a}": p[:, j] for j, a in enumerate("zyx")}})
    got = nearest._solver(["k"], [])(points, faces).sort_by("k")
    assert sum(seen) < 20 * len(p)
    a, b, c = np.moveaxis(corners.reshape(-1, 3, 3), 1, 0)
    for k, q in enumerate(p):
        d = triangle_distance(np.broadcast_to(q, g.shape), a, b, c)
        best = np.lexsort((number, number, number % 3, number % 2, ((q - g) ** 2).sum(1).round(6), d.round(9)))[0]
        assert got.column("face_row")[k].as_py() == best and got.column("dist")[k].as_py() == d[best]


def test_tiles_of_a_long_surface_are_not_crowded(spark, monkeypatch):
    """A surface far longer than wide: no tile holds more than its share, so none is split into parts that each point asks."""
    monkeypatch.setattr(nearest, "TILE", 64)
    met, parts = nearest._met, []
    monkeypatch.setattr(nearest, "_met", lambda asked, faces, *a: parts.append(faces.select("iz", "iy", "ix", "part").distinct().collect()) or met(asked, faces, *a))
    faces = mesh.faces(surface(spark, [[(20.0 * i, j, math.sin(i + j)) for j in range(4)] for i in range(200)], 1)).cache()
    points = spark.createDataFrame([(k, 79.0 * k, 1.5, 0.2) for k in range(50)], "k int, pz double, py double, px double")
    own = lambda rows: sorted((r.k, round(r.dist, 9), r.face_row, r.face_col, r.face_block) for r in rows)
    assert own(nearest_faces(points, faces, ["k"]).collect()) == own(nearest_brute(points, faces, ["k"]).collect())
    assert max(r.part for r in parts[0]) == 0 and len(parts[0]) <= 2 * faces.count() / 64


def test_points_of_one_place_are_solved_once(spark, monkeypatch):
    """Of 600 points in 6 places, some in both groups, 12 are solved, and every point gets its row."""
    solved, found = [], nearest._found
    monkeypatch.setattr(nearest, "_found", lambda points, *a: solved.append(points.count()) or found(points, *a))
    family = surface(spark, [[(i, j, math.sin(i + j)) for j in range(6)] for i in range(6)], 1)
    faces = mesh.faces(family.withColumn("grp", F.lit("a")).unionByName(family.withColumn("z", F.col("z") + F.lit(1.0).cast("float")).withColumn("grp", F.lit("b"))), ["grp"]).cache()
    rows = [(k, "ab"[k // 300], float(k % 6), 0.5 * (k % 3), 0.7) for k in range(600)] + [(600, "a", None, 0.0, 0.0), (601, "gone", 0.0, 0.0, 0.7)]
    points = spark.createDataFrame(rows, "k int, grp string, pz double, py double, px double")
    got = sorted((*key(r), r.pz, round(r.u, 9)) for r in nearest_faces(points, faces, ["k"], ["u"], ["pz"], within=["grp"]).collect())
    want = []
    for g in "ab":
        want += [(*key(r), float(r.k % 6), round(r.u, 9)) for r in nearest_brute(points.where((F.col("grp") == g) & (F.col("k") < 600)), faces.where(F.col("grp") == g).drop("grp"), ["k", "grp"], ["u"]).collect()]
    assert got == sorted(want) and solved == [14]


def test_small_grids_are_labelled_together(spark, monkeypatch):
    """300 grids that a task holds take a few jobs, not a distributed search, and have the labels each has alone; one is larger."""
    split, seen = wide_sheets._split, []
    monkeypatch.setattr(wide_sheets, "_split", lambda points, *a: seen.append(points.select("patch").distinct().count()) or split(points, *a))
    rng, rows = np.random.default_rng(8), []
    for g in range(300):
        h, w = (17, 16) if g == 7 else rng.integers(1, 7, 2)
        rows += [(g, i, j, float(rng.integers(0, 12)) / 4) for i in range(h) for j in range(w) if rng.random() < 0.8 or g == 7]
    points = spark.createDataFrame(rows, "patch long, row int, col int, u double")
    got = {(r.patch, r.row, r.col): (r.sheet_row, r.sheet_col) for r in wide_sheets.wide_sheets(points, ["patch"], block=16).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        row, col, u = (np.array(x) for x in zip(*own))
        want |= {(g, int(row[i]), int(col[i])): (int(row[k]), int(col[k])) for i, k in enumerate(sheets.sheet_labels(row, col, u))}
    assert got == want and seen == [1]
