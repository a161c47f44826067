"""DuckDB SQL of the mesh queries, from common table expressions that follow the same definitions."""

from __future__ import annotations

import math
import re

T = "6.283185307179586e0"


def num(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def with_(*ctes: str, last: str) -> str:
    recursive = any(re.search(rf"(FROM|JOIN) {x.split(' ')[0]}\b", x) for x in ctes)
    return re.sub(r'(?<!["\w])by(?!["\w])', '"by"', ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + last)  # the y of a corner b is no keyword


def rnd(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) AS {n}" for n in names)


def spiral(w: str, theta: str, pitch: float, more: str) -> tuple[str, str]:
    total = f"(({w}) * {T} + {theta})"
    radius = f"({num(pitch)} * {total} / {T} + {more})"
    return f"sin{total} * {radius}", f"cos{total} * {radius}"


def _noise(value: str, scale: float) -> str:
    return f"((CAST((floor({value}) % 100 + 100) % 100 AS DOUBLE) / 100 - 0.5e0) * {num(2 * scale)})"


def family(name: str) -> str:
    """The family woven from orders (see sources.woven)."""
    y, x = spiral("winding", f"c * {num(2 * math.pi / 90)}", 10.0, _noise("v", 0.1))
    return f"""{name} AS MATERIALIZED (SELECT winding, r, c, CAST(r * 4e0 AS FLOAT) AS z, CAST({y} AS FLOAT) AS y, CAST({x} AS FLOAT) AS x, floor(v) % 89 <> 0 AS valid
 FROM (SELECT CAST(10 + o_orderkey % 8 AS INTEGER) AS winding, CAST(o_orderkey // 8 // 90 AS INTEGER) AS r, CAST(o_orderkey // 8 % 90 AS INTEGER) AS c, o_totalprice AS v FROM orders))"""


def band(t0: float, t1: float, theta_count: int) -> str:
    t = f"(c * {num(2 * math.pi / theta_count)})"
    return f"({t} >= {num(t0)} AND {t} < {num(t1)})"


def swapped(name: str, src: str, w1: int, w2: int, t0: float, t1: float, theta_count=90) -> str:
    return f"{name} AS (SELECT CAST(CASE WHEN {band(t0, t1, theta_count)} AND winding IN ({w1}, {w2}) THEN {w1 + w2} - winding ELSE winding END AS INTEGER) AS winding, r, c, z, y, x, valid FROM {src})"


def collapsed(name: str, src: str, w: int, t0: float, t1: float, factor: float, theta_count=90) -> str:
    hit = f"(a.winding = {w} AND {band(t0, t1, theta_count).replace('(c ', '(a.c ')})"
    k = f"CAST({num(1.0 - factor)} AS FLOAT)"
    pull = lambda v: f"CASE WHEN {hit} THEN CAST(b.{v} + (a.{v} - b.{v}) * {k} AS FLOAT) ELSE a.{v} END AS {v}"
    return f"{name} AS (SELECT a.winding, a.r, a.c, a.z, {pull('y')}, {pull('x')}, a.valid FROM {src} a LEFT JOIN {src} b ON b.winding = {w - 1} AND a.r = b.r AND a.c = b.c)"


def radially(name: str, src: str, grow: str, key: str = "winding", more: str = "") -> str:
    """grow: over t (azimuth), z and winding."""
    return f"""{name} AS (SELECT {key}, r, c, z, CAST(yd / greatest(rad, 1e-9) * (rad + {grow}) + 0e0 AS FLOAT) AS y, CAST(xd / greatest(rad, 1e-9) * (rad + {grow}) + 0e0 AS FLOAT) AS x, valid{more}
 FROM (SELECT *, sqrt(yd * yd + xd * xd) AS rad, atan2(yd, xd) AS t FROM (SELECT *, CAST(y AS DOUBLE) AS yd, CAST(x AS DOUBLE) AS xd FROM {src})))"""


def holes(name: str, src: str, count: int, size: int, rows: int, cols: int, seed: int = 0) -> str:
    hit = " OR ".join(f"(r BETWEEN {i} AND {i + size - 1} AND c BETWEEN {j} AND {j + size - 1})" for i, j in (((7919 * k + 104729 * seed + 3) % max(rows - size, 1), (6101 * k + 15485863 * seed + 5) % max(cols - size, 1)) for k in range(count)))
    return f"{name} AS MATERIALIZED (SELECT winding, r, c, z, y, x, valid AND NOT ({hit}) AS valid FROM {src})"


def demo(name: str, clean: bool = False) -> list[str]:
    if clean:
        return [family(name)]
    return [family(f"{name}_0"), swapped(f"{name}_1", f"{name}_0", 13, 14, 1.0, 2.2), collapsed(name, f"{name}_1", 16, 4.0, 5.0, 0.9)]


PATCH = "concat('patch', patch, '_w', 11 + patch % 7)"


def named(last: str) -> str:
    """last with its column patch, a patch's number, as the patch's name."""
    return f"SELECT * REPLACE ({PATCH} AS patch) FROM ({last})"


def patches(name: str, patch: str = "concat('patch', number, '_w', w)") -> str:
    """The patches woven from customers (see sources.woven)."""
    y, x = spiral("w", "theta", 10.0, _noise("v", 0.2))
    return f"""{name} AS MATERIALIZED (SELECT {patch} AS patch, number, r, c, CAST((number + r) * 2e0 AS FLOAT) AS z, CAST({y} AS FLOAT) AS y, CAST({x} AS FLOAT) AS x,
 CASE WHEN seam AND NOT (c > 0 AND floor(theta / {T}) <> floor((theta - step) / {T})) THEN CAST(floor(theta / {T}) AS DOUBLE) END AS label, true AS valid
 FROM (SELECT *, start + c * step AS theta FROM (SELECT *, 11 + number % 7 AS w, number % 9 = 8 AS seam, CASE WHEN number % 9 = 8 THEN 5.6e0 ELSE CAST(number * 7 % 50 AS DOUBLE) / 10 END AS start, CASE WHEN number % 9 = 8 THEN 2.8e0 ELSE 1.2e0 END / 7 AS step
 FROM (SELECT c_custkey // 40 AS number, CAST(c_custkey % 40 // 8 AS INTEGER) AS r, CAST(c_custkey % 8 AS INTEGER) AS c, c_acctbal AS v FROM customer))))"""


STRIP_NAME = "concat(['same', 'arc', 'off', 'ladder', 'far'][collection % 5 + 1], collection) AS name"


def strips(name: str) -> str:
    """The strips woven from parts (see sources.woven), but for their source, here a number, and their names (STRIP_NAME)."""
    y, x = spiral("w", "theta", 10.0, "more")
    return f"""{name} AS MATERIALIZED (SELECT 0 AS source, collection, point, CAST((collection % 20) * 2e0 + point AS DOUBLE) AS z, {y} AS y, {x} AS x, CASE WHEN kind = 3 AND v < 48 THEN CAST(point % 5 AS DOUBLE) END AS wind_a
 FROM (SELECT *, CASE kind WHEN 3 THEN 11 + point % 5 WHEN 4 THEN 30 + point ELSE 11 + collection % 6 END AS w, CASE WHEN kind = 3 THEN 1.5e0 ELSE CAST(collection % 6 AS DOUBLE) + point * CASE WHEN kind = 1 THEN {num(2 * math.pi * 0.75 / 9)} ELSE 0.1e0 END END AS theta, CASE WHEN kind = 2 AND v <= 3 THEN 10e0 ELSE 0.3e0 END AS more
 FROM (SELECT *, collection % 5 AS kind FROM (SELECT p_partkey // 10 AS collection, p_partkey % 10 AS point, p_size AS v FROM part))))"""


def quads(name: str, src: str, key: str, carry: str = "") -> str:
    extra = "".join(f", {t}.{carry} AS {carry}{k}" for t, k in zip("abde", ("00", "10", "01", "11"))) if carry else ""
    cols = ", ".join(f"{t}.{v} AS {v}{k}" for t, k in zip("abde", ("00", "10", "01", "11")) for v in "zyx")
    on = lambda t, i, j: f"JOIN {src} {t} ON a.{key} = {t}.{key} AND a.r + {i} = {t}.r AND a.c + {j} = {t}.c AND {t}.valid"
    return f"{name} AS (SELECT a.{key}, a.r, a.c, {cols}{extra} FROM {src} a {on('b', 1, 0)} {on('d', 0, 1)} {on('e', 1, 1)} WHERE a.valid)"


def centers(name: str, src: str) -> str:
    mean = ", ".join(f"CAST(CAST(CAST({v}00 + {v}10 + {v}01 + {v}11 AS FLOAT) / 4.0 AS FLOAT) AS DOUBLE) AS p{v}" for v in "zyx")
    return f"{name} AS (SELECT *, {mean} FROM {src})"


def _cross(a: str, b: str) -> list[str]:
    return [f"({a}y * {b}x - {a}x * {b}y)", f"({a}x * {b}z - {a}z * {b}x)", f"({a}z * {b}y - {a}y * {b}z)"]


def quad_normals(name: str, src: str) -> str:
    d = ", ".join(f"CAST(CAST({v}11 - {v}00 AS FLOAT) AS DOUBLE) AS d{v}, CAST(CAST({v}01 - {v}10 AS FLOAT) AS DOUBLE) AS e{v}" for v in "zyx")
    n = ", ".join(f"{c} AS k{v}" for c, v in zip(_cross("d", "e"), "zyx"))
    u = ", ".join(f"k{v} / greatest(sqrt(kz * kz + ky * ky + kx * kx), 1e-12) AS n{v}" for v in "zyx")
    return f"{name} AS (SELECT *, {u} FROM (SELECT *, {n} FROM (SELECT *, {d} FROM {src})))"


def faces(name: str, src: str) -> list[str]:
    q = quads(f"{name}_q", src, "winding")
    tri = lambda block, ks: "SELECT winding, r, c, " + f"{block} AS block, winding + (c + 0.5e0) / greatest(w - 1, 1) AS u, " + ", ".join(f"CAST({v}{k} AS DOUBLE) AS {n}{v}" for n, k in zip("abc", ks) for v in "zyx") + f" FROM {name}_q JOIN {name}_w USING (winding)"
    g = ", ".join(f"(a{v} + b{v} + c{v}) / 3 AS g{v}" for v in "zyx")
    d = ", ".join(f"b{v} - a{v} AS s{v}, c{v} - a{v} AS t{v}" for v in "zyx")
    n = ", ".join(f"{c} AS k{v}" for c, v in zip(_cross("s", "t"), "zyx"))
    m = ", ".join(f"k{v} / greatest(sqrt(kz * kz + ky * ky + kx * kx), 1e-12) AS m{v}" for v in "zyx")
    rad = "greatest(" + ", ".join("sqrt(" + " + ".join(f"({p}{v} - g{v}) * ({p}{v} - g{v})" for v in "zyx") + ")" for p in "abc") + ") AS radius"
    return [q, f"{name}_w AS (SELECT winding, max(c) + 1 AS w FROM {src} GROUP BY winding)", f"{name}_t AS ({tri(0, ('10', '00', '01'))} UNION ALL {tri(1, ('10', '01', '11'))})", f"{name} AS (SELECT *, {m}, {rad} FROM (SELECT *, {n} FROM (SELECT *, {g}, {d} FROM {name}_t)))"]


def nearest(name: str, points: str, keys: list[str], face: str, keep: list[str] = (), within: str | None = None) -> list[str]:
    """keys, dist, winding, fr, fc, fblock and keep of the face nearest to each row (pz, py, px) of points, over all pairs (of equal `within`)."""
    met = f"{points} p JOIN {face} f ON p.{within} = f.{within}" if within else f"{points} p CROSS JOIN {face} f"
    dots = {1: ("ab", "a"), 2: ("ac", "a"), 3: ("ab", "b"), 4: ("ac", "b"), 5: ("ab", "c"), 6: ("ac", "c")}
    d = ", ".join("(" + " + ".join(f"({e[1]}{v} - a{v}) * (p{v} - {o}{v})" for v in "zyx") + f") AS d{k}" for k, (e, o) in dots.items())
    g2 = "(" + " + ".join(f"(p{v} - g{v}) * (p{v} - g{v})" for v in "zyx") + ") AS g2"
    key = ", ".join(f"p.{k} AS k_{k}" for k in keys)
    safe = lambda x: f"(CASE WHEN abs({x}) < 1e-12 THEN 1e-12 ELSE {x} END)"
    where = ["d1 <= 0 AND d2 <= 0", "d3 >= 0 AND d4 <= d3", "d6 >= 0 AND d5 <= d6", "vc <= 0 AND d1 >= 0 AND d3 <= 0", "vb <= 0 AND d2 >= 0 AND d6 <= 0", "va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0"]
    along, whole = f"((d4 - d3) / {safe('((d4 - d3) + (d5 - d6))')})", safe("(va + vb + vc)")
    case = lambda xs, rest: "CASE " + " ".join(f"WHEN {w} THEN {x}" for w, x in zip(where, xs)) + f" ELSE {rest} END"
    v = case(["0e0", "1e0", "0e0", f"d1 / {safe('(d1 - d3)')}", "0e0", f"1e0 - {along}"], f"vb / {whole}")
    w = case(["0e0", "0e0", "1e0", "0e0", f"d2 / {safe('(d2 - d6)')}", along], f"vc / {whole}")
    dist = "sqrt(" + " + ".join(f"(p{x} - (a{x} + v * (b{x} - a{x}) + w * (c{x} - a{x}))) * (p{x} - (a{x} + v * (b{x} - a{x}) + w * (c{x} - a{x})))" for x in "zyx") + ")"
    cols = ", ".join([*(f"p.p{v}" for v in "zyx"), *(f"f.{n}{v}" for n in "abcg" for v in "zyx"), "f.winding AS fw", "f.r AS fr", "f.c AS fc", "f.block AS fb", *(f"f.{k}" for k in keep)])
    pack = ", ".join([f"'{n}': {e}" for n, e in (("d", "round(dist, 9)"), ("g", "round(g2, 6)"), ("fb", "fb"), ("fw", "fw"), ("fr", "fr"), ("fc", "fc"), ("dist", "dist"), *((k, k) for k in keep))])
    out = ", ".join([*(f"k_{k} AS {k}" for k in keys), "b.dist AS dist", "b.fw AS winding", "b.fr AS fr", "b.fc AS fc", "b.fb AS fblock", *(f"b.{k} AS {k}" for k in keep)])
    far = "(" + " + ".join(f"(p.p{v} - f.g{v}) * (p.p{v} - f.g{v})" for v in "zyx") + ")"
    known = ", ".join([*(f"p.{k} AS {k}" for k in keys), *(f"any_value(p.p{v}) AS p{v}" for v in "zyx")])
    again = met.replace(f"{points} p ", f"{name}_l p ", 1)
    return [  # a centroid lies on its face, so the nearest centroid bounds the distance
        f"{name}_l AS MATERIALIZED (SELECT {known}, min({far}) AS lim FROM {met} GROUP BY ALL)",
        f"{name}_p AS MATERIALIZED (SELECT *, {d}, {g2} FROM (SELECT {key}, {cols} FROM {again} WHERE sqrt({far}) - f.radius <= sqrt(p.lim) + 1e-9))",
        f"{name}_v AS (SELECT *, {v} AS v, {w} AS w FROM (SELECT *, d1 * d4 - d3 * d2 AS vc, d5 * d2 - d1 * d6 AS vb, d3 * d6 - d5 * d4 AS va FROM {name}_p))",
        f"{name}_b AS (SELECT {', '.join(f'k_{k}' for k in keys)}, min({{{pack}}}) AS b FROM (SELECT *, {dist} AS dist FROM {name}_v) GROUP BY ALL)",
        f"{name} AS MATERIALIZED (SELECT {out} FROM {name}_b)",
    ]


def scored(clean: bool = False, inputs: bool = True) -> list[str]:
    """pts: point scores of the patches; the inputs are every third of them."""
    keys = ["patch", "r", "c"]
    ctes = [*demo("fam", clean), patches("pat", "number"), quads("pq", "pat", "patch", "label"), centers("pc", "pq"), quad_normals("pn", "pc"), *faces("f", "fam"), *nearest("near", "pn", keys, "f", ["u", "mz", "my", "mx"])]
    if inputs:
        ctes += ["ins AS (SELECT CAST(number AS INTEGER) AS winding, r, c, z, y, x, valid FROM pat WHERE number % 3 = 0)", *faces("fi", "ins"), *nearest("near_i", "pn", keys, "fi")]
    angle = "degrees(acos(least(abs(nz * mz + ny * my + nx * mx), 1e0)))"
    extra = ", i.dist AS input_dist" if inputs else ", CAST(NULL AS DOUBLE) AS input_dist"
    join = " JOIN near_i i ON n.patch = i.patch AND n.r = i.r AND n.c = i.c" if inputs else ""
    ctes.append(f"pts AS MATERIALIZED (SELECT n.patch, n.r, n.c, pz AS z, py AS y, px AS x, (label00 + label01 + label10 + label11) / 4 AS quad_label, n.dist, n.winding, n.u, {angle} AS angle{extra} FROM pn JOIN near n ON pn.patch = n.patch AND pn.r = n.r AND pn.c = n.c{join})")
    return ctes


def modal(name: str, src: str, key: str, value: str) -> str:
    return f"""{name} AS (SELECT {key}, v AS mode, n / total AS share, CAST(total AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, v) AS nth_, sum(n) OVER (PARTITION BY {key}) AS total
 FROM (SELECT {key}, {value} AS v, count(*) AS n FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL)) WHERE nth_ = 1)"""


def sheets() -> list[str]:
    """sheet: a sheet number for each row of pts."""
    return [
        "nodes AS (SELECT patch, r, c, u, r * 100000 + c AS id FROM pts)",
        "e0 AS (SELECT a.patch, 0 AS way, a.id AS a, b.id AS b, b.u - a.u AS du FROM nodes a JOIN nodes b ON a.patch = b.patch AND a.r + 1 = b.r AND a.c = b.c UNION ALL SELECT a.patch, 1, a.id, b.id, b.u - a.u FROM nodes a JOIN nodes b ON a.patch = b.patch AND a.r = b.r AND a.c + 1 = b.c)",
        "e1 AS (SELECT * FROM e0 WHERE abs(du) <= 0.5)",
        "e2 AS (SELECT patch, a, b FROM e1 UNION SELECT patch, b, a FROM e1)",
        "drift AS (SELECT p.patch, coalesce(median(du) FILTER (way = 0), 0) AS drift_row, coalesce(median(du) FILTER (way = 1), 0) AS drift_col FROM (SELECT DISTINCT patch FROM nodes) p LEFT JOIN e1 ON p.patch = e1.patch GROUP BY p.patch)",
        "reach AS (SELECT patch, id AS a, id AS b FROM nodes UNION SELECT reach.patch, reach.a, e2.b FROM reach JOIN e2 ON reach.patch = e2.patch AND reach.b = e2.a)",
        "comp AS (SELECT patch, a AS id, min(b) AS comp FROM reach GROUP BY ALL)",
        "nc AS (SELECT nodes.*, comp FROM nodes JOIN comp USING (patch, id))",
        "close AS (SELECT a.patch, a.comp AS ca, b.comp AS cb, arg_min({'ar': a.r, 'ac': a.c, 'au': a.u, 'br': b.r, 'bc': b.c, 'bu': b.u}, {'d': (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), 'i': a.id, 'j': b.id}) AS p FROM nc a JOIN nc b ON a.patch = b.patch AND a.comp < b.comp GROUP BY ALL)",
        "m0 AS (SELECT close.patch, ca, cb FROM close JOIN drift USING (patch) WHERE abs((p.bu - p.au) - (drift_row * (p.br - p.ar) + drift_col * (p.bc - p.ac))) <= 0.5)",
        "m1 AS (SELECT patch, ca, cb FROM m0 UNION SELECT patch, cb, ca FROM m0)",
        "mreach AS (SELECT DISTINCT patch, comp AS a, comp AS b FROM nc UNION SELECT mreach.patch, mreach.a, m1.cb FROM mreach JOIN m1 ON mreach.patch = m1.patch AND mreach.b = m1.ca)",
        "merged AS (SELECT patch, a AS comp, min(b) AS sheet FROM mreach GROUP BY ALL)",
        "sheet AS (SELECT nc.patch, r, c, sheet FROM nc JOIN merged USING (patch, comp))",
        "share AS (SELECT patch, max(n) / sum(n) AS sheet_consistency FROM (SELECT patch, sheet, count(*) AS n FROM sheet GROUP BY ALL) GROUP BY patch)",
    ]


def agreement() -> list[str]:
    return [
        "mids AS (SELECT patch, median(quad_label) AS mid FROM pts WHERE quad_label IS NOT NULL GROUP BY patch HAVING count(*) >= 2)",
        "told AS (SELECT pts.patch, round_even(quad_label - mid, 0) AS told, winding FROM pts JOIN mids USING (patch) WHERE quad_label IS NOT NULL)",
        modal("tm", "told", "patch", "told"), modal("om", "told", "patch", "winding"),
        "agr AS (SELECT told.patch, avg(CASE WHEN told - tm.mode = winding - om.mode THEN 1.0 ELSE 0.0 END) AS agreement FROM told JOIN tm ON told.patch = tm.patch JOIN om ON told.patch = om.patch GROUP BY told.patch)",
    ]


def quantiles(prefix: str, value: str) -> str:
    return ", ".join(f"quantile_cont({value}, {q}) AS {prefix}_{n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + f", max({value}) AS {prefix}_max"


def axis(points: list[tuple[float, float, float]], name: str = "axis") -> str:
    return f"{name} AS (SELECT z AS z0, y AS y0, x AS x0, lead(z) OVER (ORDER BY z) AS z1, lead(y) OVER (ORDER BY z) AS y1, lead(x) OVER (ORDER BY z) AS x1, row_number() OVER (ORDER BY z) AS n FROM (VALUES " + ", ".join("(" + ", ".join(map(num, p)) + ")" for p in points) + ") a(z, y, x))"


def axis_at(name: str, src: str, z: str, axis: str = "axis") -> str:
    t = f"(CASE WHEN z1 IS NULL OR {z} <= z0 THEN 0e0 ELSE ({z} - z0) / (z1 - z0) END)"
    return f"{name} AS (SELECT s.*, y0 + {t} * (coalesce(y1, y0) - y0) AS ay, x0 + {t} * (coalesce(x1, x0) - x0) AS ax FROM {src} s JOIN {axis} ON ({z} >= z0 OR n = 1) AND ({z} < z1 OR z1 IS NULL))"


def gap_cells(src: str, points, p="", z_bins=10, theta_bins=48) -> list[str]:
    """cells, g and cls (after p): binned radii, gaps and classed gaps of family src."""
    edge = lambda k: "hi" if k == z_bins else f"(lo + {num(k)} * ((hi - lo) / {z_bins}))"
    zb = " + ".join(f"CAST(z >= {edge(k)} AS INTEGER)" for k in range(1, z_bins))
    mid = "CASE zb " + " ".join(f"WHEN {k} THEN ({edge(k)} + {edge(k + 1)}) / 2" for k in range(z_bins)) + " END"
    return [
        axis(points, f"{p}axis"),
        f"{p}v0 AS (SELECT winding, CAST(z AS DOUBLE) AS z, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x FROM {src} WHERE valid)",
        f"{p}ends AS (SELECT min(z) AS lo, max(z) + 1e-6 AS hi FROM {p}v0)",
        f"{p}v1 AS (SELECT *, {mid} AS zc FROM (SELECT *, {zb} AS zb FROM {p}v0, {p}ends))",
        axis_at(f"{p}v2", f"{p}v1", "zc", f"{p}axis"),
        f"{p}v3 AS (SELECT winding, zb, sqrt((y - ay) * (y - ay) + (x - ax) * (x - ax)) AS rad, CAST(least(greatest(floor((atan2(y - ay, x - ax) + {num(math.pi)}) / ({T}) * {theta_bins}), 0), {theta_bins - 1}) AS INTEGER) AS tb FROM {p}v2)",
        f"{p}cells AS (SELECT winding, zb, tb, avg(rad) AS mean_r, count(*) AS n FROM {p}v3 GROUP BY ALL HAVING count(*) >= 3)",
        f"{p}nxt AS (SELECT winding, lead(winding) OVER (ORDER BY winding) AS o FROM (SELECT DISTINCT winding FROM {src}))",
        f"{p}g AS (SELECT a.winding AS inner_w, a.zb, a.tb, (b.mean_r - a.mean_r) / (o - a.winding) AS gap FROM {p}cells a JOIN {p}nxt x ON a.winding = x.winding JOIN {p}cells b ON b.winding = o AND a.zb = b.zb AND a.tb = b.tb)",
        f"{p}cls AS (SELECT *, CASE WHEN gap <= 0 THEN 'violation' WHEN gap < 0.2 * pitch THEN 'collapsed' WHEN gap > 2.5 * pitch THEN 'inflated' ELSE 'ok' END AS kind FROM (SELECT *, (SELECT median(gap) FROM {p}g) AS pitch FROM {p}g))",
    ]
